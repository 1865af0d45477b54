"""Records that span lines and splits, against the whole-file readers and Python's own parsers."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from textcurate.operators.rowindex import with_row_index
from textcurate.schema import BLOCK, FILE, ROW_INDEX
from textcurate.sources import readers, spans
from textcurate.sources.readers import read_csv, read_json


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def cells(pick):
    parts = ["a", "b c", ",", "\n", '"', "\n\n", "é", "x" * 40, "12", ", ", '",', "\n,"]
    return "".join(pick.choice(parts) for _ in range(pick.randint(0, 9)))


def csv_text(seed, rows, newline="\n", long_cell=0):
    pick = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline)
    writer.writerow(["id", "text", "more"])
    for k in range(rows):
        text = cells(pick) or "t"
        if k == rows // 2 and long_cell:
            text = "long\n" * long_cell
        writer.writerow([k, text, cells(pick)])
    return out.getvalue()


def rows_in_order(df, *names):
    return [tuple(r) for r in with_row_index(df).orderBy(ROW_INDEX).select(*names).collect()]


@pytest.mark.parametrize("newline,long_cell,end", [("\n", 0, True), ("\n", 400, False), ("\r\n", 0, True)])
@pytest.mark.parametrize("seed", [1, 2])
def test_quoted_csv_in_splits_equals_the_whole_file(spark, tmp_path, small_splits, seed, newline, long_cell, end):
    content = csv_text(seed, 60, newline, long_cell)
    path = tmp_path / "a.csv"
    path.write_bytes((content if end else content.removesuffix(newline)).encode())
    found = read_csv(spark, str(path))
    records = spans.read_records(spark, str(path), spans.CSV)
    assert records.filter(F.col(BLOCK) % 300 == 0).select(BLOCK).distinct().count() > 3
    whole = spark.read.options(header=True, escape='"', multiLine=True, inferSchema=False).csv(str(path))
    whole = readers.drop_na_tokens(whole, whole.columns)
    got = rows_in_order(found.select(F.col("id").cast("string").alias("id"), "text", "more", FILE, BLOCK), "id", "text", "more")
    assert got == [tuple(r) for r in whole.collect()]
    assert [r[0] for r in got] == [str(k) for k in range(60)]


def test_many_files_blank_lines_and_a_long_header(spark, tmp_path, small_splits):
    folder = tmp_path / "a b.csv"
    folder.mkdir()
    header = '"id","' + "h\n" * 250 + '"\n'
    for number in range(3):
        body = "".join(f'{number}{k},"x\ny"\n' if k % 3 else "\n" for k in range(50))
        (folder / f"{number}.csv").write_text(header + body)
    (folder / "3.csv").write_text(header.replace("\n" * 2, "\n") + '99,"plain"\n')
    found = rows_in_order(read_csv(spark, str(folder)), "id")
    assert found == [(int(f"{n}{k}"),) for n in range(3) for k in range(50) if k % 3] + [(99,)]


def test_carriage_returns_within_lines_are_read_as_a_whole(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'id,text\r1,"a\rb"\r2,c\r')
    assert [tuple(r) for r in read_csv(spark, str(path)).select("id", "text").collect()] == [(1, "a\nb"), (2, "c")]


def test_a_schema_holds_in_splits(spark, tmp_path, small_splits):
    path = tmp_path / "a.csv"
    path.write_text("id,text\n" + "".join(f'{k},"l\n{k}"\n' for k in range(200)))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType())])
    assert rows_in_order(read_csv(spark, str(path), schema), "id", "text") == [(k, f"l\n{k}") for k in range(200)]


def json_records(seed, n):
    pick = random.Random(seed)
    odd = ["}", "{", '"', "\\", "]", "[", "\n", "},{", "é", "x" * 30, '\\"', "\\\\"]
    words = lambda: "".join(pick.choice(odd) for _ in range(pick.randint(0, 8)))
    return [{"id": k, "text": words(), "deep": {"list": [{"w": words()}] * pick.randint(0, 2), "z": None}} for k in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_json_arrays_in_splits(spark, tmp_path, small_splits, seed, indent):
    records = json_records(seed, 80)
    path = tmp_path / "a.json"
    path.write_text("\ufeff" * (seed - 1) + json.dumps(records, indent=indent, ensure_ascii=seed == 1) + "\n")
    found = read_json(spark, str(path))
    assert found.select(BLOCK).distinct().count() > 3
    got = rows_in_order(found, F.to_json(F.struct("deep", "id", "text"), {"ignoreNullFields": "false"}))
    assert [json.loads(r[0])["text"] for r in got] == [r["text"] for r in records]
    assert [json.loads(r[0])["deep"]["list"] for r in got] == [r["deep"]["list"] for r in records]
    assert [json.loads(r[0])["id"] for r in got] == list(range(80))
    whole = spark.read.option("multiLine", True).json(str(path))
    assert whole.schema == found.drop(FILE, BLOCK).schema


def test_empty_arrays_and_a_single_record(spark, tmp_path):
    folder = tmp_path / "a.json"
    folder.mkdir()
    (folder / "0.json").write_text("[]")
    (folder / "1.json").write_text(' [ {"id": 1} ] ')
    (folder / "2.json").write_text('{"id": 2}\n{"id": 3}\n')
    assert sorted(r.id for r in read_json(spark, str(folder)).collect()) == [1, 2, 3]


def test_broken_json_fails(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"id": 1}, {"id" 2}]')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_json(spark, str(path)).collect()


@pytest.mark.parametrize("seed", range(3))
def test_steps_equal_a_character_automaton(seed):
    pick = random.Random(seed)
    for _ in range(3000):
        line = "".join(pick.choice('",ab') for _ in range(pick.randint(0, 9)))
        for inside in (0, 1):
            state = "quoted" if inside else "start"
            k = 0
            while k < len(line):
                c = line[k]
                if state == "quoted":
                    if c == '"':
                        if line[k + 1 : k + 2] == '"':
                            k += 1
                        else:
                            state = "plain"
                elif c == ",":
                    state = "start"
                elif state == "start" and c == '"':
                    state = "quoted"
                else:
                    state = "plain"
                k += 1
            assert spans.csv_step(line, inside) == (int(state == "quoted"), 0), (line, inside)
        piece = "".join(pick.choice('"\\{}[]a') for _ in range(pick.randint(0, 9))) + "}"
        for inside in (0, 1):
            string, depth, k = bool(inside), 0, 0
            while k < len(piece):
                c = piece[k]
                if string and c == "\\":
                    k += 1
                elif c == '"':
                    string = not string
                elif not string:
                    depth += (c in "{[") - (c in "}]")
                k += 1
            if not piece.endswith("\\}") or not string:
                assert spans.json_step(piece, inside) == (int(string), depth), (piece, inside)


def test_lines_without_quotes_are_not_parsed(monkeypatch):
    monkeypatch.setattr(spans, "_CSV_CELLS", None)
    monkeypatch.setattr(spans, "_CSV_CLOSE", None)
    assert spans.csv_step("a,b,", 0) == (0, 0) and spans.csv_step("a,b,", 1) == (1, 0) and spans.csv_step("", 1) == (1, 0)
