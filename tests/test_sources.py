"""Readers, writers, row index."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcurate.operators.rowindex import with_row_index
from textcurate.schema import ROW_INDEX, SOURCE_POSITION, ensure_curation_columns
from textcurate.sources import readers
from textcurate.sources.documents import docx_texts
from textcurate.sources.plaintext import split_paragraphs
from textcurate.sources.readers import read_dataset, read_json, read_table
from textcurate.sources.writers import default_target, write_table


def indexed(source):
    return with_row_index(ensure_curation_columns(source.rows), source.order_by).orderBy(ROW_INDEX)


def texts(source):
    return [r[source.text_column] for r in indexed(source).collect()]


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(path)


CSV = (
    "id,text,keep,n\n"
    '1,"says ""hi"", twice",true,5\n'
    '2,"two\nlines",False,NA\n'
    "3,NA,1,7\n"
    "4,nan,yes,8\n"
    "5,NULL,0,9\n"
    "6,,no,1\n"
    "7,Ünïcödé,,2\n"
    '8,"  padded ",keep,3\n'
)


def test_csv_cells_and_types(spark, tmp_path):
    source = read_dataset(spark, write(tmp_path / "a.csv", CSV))
    rows = indexed(source).collect()
    assert [r.text for r in rows] == ['says "hi", twice', "two\nlines", "Ünïcödé", "  padded "]
    assert [r[ROW_INDEX] for r in rows] == [0, 1, 2, 3]
    assert [r.keep for r in rows] == [True, False, True, True]
    types = {f.name: f.dataType for f in source.rows.schema.fields}
    assert types["id"] == T.LongType() and types["n"] == T.LongType()
    assert [r.n for r in rows] == [5, None, 2, 3]


@pytest.mark.parametrize("multiline", [None, True])
def test_csv_files_are_split_unless_cells_span_lines(spark, tmp_path, multiline):
    folder = tmp_path / "some data"
    folder.mkdir()
    plain = "".join(f'{i},"plain ""{i}"", é"\r\n' for i in range(500))
    write(folder / "a.csv", "id,text\r\n" + plain)
    write(folder / "b.csv", 'id,text\n500,"two\nlines"\n501,"a\rb"\n502,5" disk\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.read_csv(spark, str(folder / "*.csv"), multiline=multiline)
        found = with_row_index(rows).orderBy(ROW_INDEX).collect()
        scans = readers.read_csv(spark, str(folder / "a.csv"), multiline=multiline).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.id for r in found] == list(range(503))
    assert found[7].text == 'plain "7", é'
    assert [r.text for r in found[500:]] == ["two\nlines", "a\rb", '5" disk']
    assert (scans > 3) is (multiline is None)


def test_csv_types_are_the_narrowest_that_fit(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b,c,d,text\n1,1.5,true,x,t\n-2,1e3,FALSE,2,u\n+3,.5,,3,v\n")
    rows = readers.read_csv(spark, path).orderBy("text").collect()
    assert [(r.a, r.b, r.c, r.d) for r in rows] == [(1, 1.5, True, "x"), (-2, 1000.0, False, "2"), (3, 0.5, None, "3")]


def test_csv_with_a_schema_still_drops_missing_words(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType())])
    source = read_dataset(spark, write(tmp_path / "a.csv", "id,text\n1,NA\n2,b\n"), schema=schema)
    assert texts(source) == ["b"]


def test_numeric_text_column_becomes_string(spark, tmp_path):
    assert texts(read_dataset(spark, write(tmp_path / "a.csv", "text\n5\n7\n"))) == ["5", "7"]


@pytest.mark.parametrize("suffix", [".jsonl", ".ndjson"])
def test_json_lines(spark, tmp_path, suffix):
    path = write(tmp_path / f"a{suffix}", '{"a":1,"text":""}\n{"a":2,"text":null}\n{"a":3}\n{"a":4,"text":"é"}\n')
    assert texts(read_dataset(spark, path)) == ["", "é"]


def test_json_array_and_json_lines_under_the_same_suffix(spark, tmp_path):
    array = write(tmp_path / "a.json", '\n[{"text":"one"},\n {"text":"two"}]\n')
    lines = write(tmp_path / "b.json", '{"text":"one"}\n{"text":"two"}\n')
    assert texts(read_dataset(spark, array)) == texts(read_dataset(spark, lines)) == ["one", "two"]


def test_parquet_index_counts_rows_with_text_across_files(spark, tmp_path):
    rows = spark.range(0, 50, numPartitions=5).select("id", F.expr("IF(id % 7 = 0, NULL, concat('t', id))").alias("text"))
    rows.write.parquet(str(tmp_path / "a.parquet"))
    found = indexed(read_dataset(spark, str(tmp_path / "a.parquet"))).collect()
    assert [r.id for r in found] == [i for i in range(50) if i % 7]
    assert [r[ROW_INDEX] for r in found] == list(range(len(found)))


def test_parquet_index_without_gaps(spark, tmp_path):
    spark.range(0, 40, numPartitions=4).selectExpr("id", "string(id) AS text").write.parquet(str(tmp_path / "a.parquet"))
    found = indexed(read_dataset(spark, str(tmp_path / "a.parquet"))).collect()
    assert [(r.id, r[ROW_INDEX]) for r in found] == [(i, i) for i in range(40)]
    assert not set(found[0].asDict()) & set(SOURCE_POSITION)


def test_index_by_columns(spark):
    rows = spark.range(100).select((99 - F.col("id")).alias("k")).repartition(7)
    assert all(r.k == r[ROW_INDEX] for r in with_row_index(rows, ["k"]).collect())


def test_plain_text_paragraphs(spark, tmp_path):
    content = b"one\r\nmore\r\n\r\ntwo \xff\r\n \r\nstill two\r\n\r\n\r\n\r\n  three\t\r\n\r\n   \r\n"
    source = read_dataset(spark, write(tmp_path / "a.txt", content))
    assert texts(source) == ["one\nmore", "two �\n \nstill two", "three"]


def test_short_plain_text_is_read_by_line(spark, tmp_path):
    source = read_dataset(spark, write(tmp_path / "a.md", "# title\n\nbody one\x0cbody two\n  \nend  last "))
    assert texts(source) == ["# title", "body one", "body two", "end", "last"]


def test_the_line_rule_is_per_file(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    write(folder / "a.txt", "l1\nl2\n")
    write(folder / "b.txt", "p1\nx\n\np2\n\np3")
    assert texts(read_dataset(spark, str(folder / "*.txt"))) == ["l1", "l2", "p1\nx", "p2", "p3"]


def test_large_text_file_is_read_in_splits(spark, tmp_path):
    paragraphs = [f"p{i} " + "x" * (i % 50) + ("\nnext" if i % 3 else "") for i in range(4000)]
    path = write(tmp_path / "a.txt", "\n\n".join(paragraphs))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert texts(read_dataset(spark, path)) == [p.strip() for p in paragraphs]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def python_paragraphs(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    parts = [p.strip() for p in text.split("\n\n") if p.strip()]
    return parts if len(parts) >= 3 else [line.strip() for line in text.splitlines() if line.strip()]


SAMPLES = ["a\n\n\nb\n\nc", "a\n \nb", "", " \n\n ", "a\rb\r\r\nc\n\nd\n\n e ", "x\x0by\x1cz\x85w v", "\n\na\n\nb\n\n\n\nc\n"]


def test_split_paragraphs_is_like_python(spark):
    rows = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, text string")
    for r in rows.select("i", split_paragraphs(F.col("text")).alias("parts")).collect():
        assert r.parts == python_paragraphs(SAMPLES[r.i]), SAMPLES[r.i]


@pytest.mark.parametrize("sample", SAMPLES)
def test_files_are_split_like_strings(spark, tmp_path, sample):
    path = write(tmp_path / "a.txt", sample)
    expected = python_paragraphs(sample)
    if expected:
        assert texts(read_dataset(spark, path)) == expected
    else:
        with pytest.raises(ValueError, match="holds no text"):
            read_dataset(spark, path)


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs):
    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}{table}</w:body></w:document>')
    return buffer.getvalue()


def run(text):
    return f"<w:r><w:t>{text}</w:t></w:r>"


def test_docx_paragraphs(spark, tmp_path):
    link = f"<w:hyperlink>{run('link')}</w:hyperlink>"
    content = docx(run(" first ") + run("half"), run("  "), run("see ") + link + run(" there"), "", run("a") + "<w:r><w:tab/><w:br/></w:r>" + run("b"))
    assert docx_texts(content)[2] == "see link there"
    source = read_dataset(spark, write(tmp_path / "a.docx", content))
    assert texts(source) == ["first half", "see link there", "a\t\nb"]


def test_docx_without_text(spark, tmp_path):
    with pytest.raises(ValueError, match="holds no text"):
        read_dataset(spark, write(tmp_path / "a.docx", docx("")))


def page_splitter():
    # A local function travels to the workers by value; they cannot import this file.
    return lambda content: content.decode().split("|")


def test_paged_documents(spark, tmp_path):
    source = read_dataset(spark, write(tmp_path / "a.pdf", " one | |three"), extractor=page_splitter())
    assert [(r.page, r.text) for r in indexed(source).collect()] == [(1, "one"), (3, "three")]


def test_paged_document_without_text(spark, tmp_path):
    with pytest.raises(ValueError, match="may be images"):
        read_dataset(spark, write(tmp_path / "a.pdf", " | "), extractor=page_splitter())


def test_text_column_choice(spark, tmp_path):
    titled = spark.createDataFrame([("t", "xxxx", 1)], "title string, other string, n int")
    assert readers.choose_text_column(titled, "text") == "title"
    assert readers.choose_text_column(titled, "other") == "other"
    plain = spark.createDataFrame([("ab", "a", None), ("ab", "ab", "abcd")], "a string, b string, c string")
    # The missing cell counts with three letters, so c has a mean of 3.5.
    assert readers.choose_text_column(plain, "text") == "c"
    tied = spark.createDataFrame([("ab", "cd")], "p string, q string")
    assert readers.choose_text_column(tied, "text") == "p"
    with pytest.raises(KeyError, match="there is no column"):
        readers.choose_text_column(spark.createDataFrame([(1,)], "n int"), "text")


def test_unknown_and_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing to read"):
        read_dataset(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="cannot read files of type '.xls'"):
        read_dataset(spark, write(tmp_path / "a.xls", "x"))


AWKWARD = [
    (1, 'quote " and, comma', 1.5),
    (2, "line\nbreak", None),
    (3, "carriage\rreturn", 2.0),
    (4, "  spaces  ", 0.1),
    (5, "back\\slash \\\" mix", 3.0),
    (6, "日本語 é 🎉", 4.0),
    (7, "'single'", 5.0),
    (8, '"', 6.0),
]


@pytest.mark.parametrize("suffix", [".csv", ".jsonl", ".ndjson", ".json", ".parquet"])
def test_round_trip(spark, tmp_path, suffix):
    target = str(tmp_path / f"out{suffix}")
    rows = spark.createDataFrame(AWKWARD, "id bigint, text string, v double")
    assert write_table(rows, target) == len(AWKWARD)
    found = read_dataset(spark, target).rows.select("id", "text", "v").collect()
    assert sorted(tuple(r) for r in found) == AWKWARD


def test_json_lines_keep_nulls_and_letters(spark, tmp_path):
    target = tmp_path / "out.jsonl"
    write_table(spark.createDataFrame([("é", None, float("nan"))], "a string, b int, c double"), str(target))
    lines = [line for part in target.glob("part-*") for line in part.read_text("utf-8").splitlines()]
    assert lines == ['{"a":"é","b":null,"c":null}']


def test_unsupported_target(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot write files"):
        write_table(spark.range(1), str(tmp_path / "out.xls"))


def test_default_targets():
    assert default_target("/d/a.CSV", "kept") == "/d/a.kept.csv"
    assert default_target("/d/a.parquet/", "curated") == "/d/a.curated.parquet"
    assert default_target("/d/a.pdf", "kept") == "/d/a.kept.jsonl"


def test_long_integers_in_csv(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("id,big,mixed,real\n1234567890123456789,99999999999999999999,1.5,1e3\n1234567890123456788,1,1234567890123456789,2\n")
    rows = read_table(spark, str(path)).select("id", "big", "mixed", "real")
    assert [t for _, t in rows.dtypes] == ["bigint", "string", "string", "double"]
    assert [r.id for r in rows.collect()] == [1234567890123456789, 1234567890123456788]


def test_json_forms_are_told_per_file(spark, tmp_path):
    folder = tmp_path / "both.json"
    folder.mkdir()
    (folder / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    (folder / "b.json").write_text("\n".join('{"a": %d}' % k for k in range(3, 103)))
    assert sorted(r.a for r in read_table(spark, str(folder)).collect()) == list(range(1, 103))
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert read_json(spark, str(folder / "b.json"), schema).count() == 100
    assert read_json(spark, str(folder), schema).count() == 102


def test_records_that_span_lines_are_cut_once(spark, tmp_path, monkeypatch):
    """Not again for every look at them; what is stored keeps its order, however many tasks read a split of it."""
    records = "".join(f'{i},"{i}\nlines"\n' for i in range(300))
    path = write(tmp_path / "a.csv", "id,text\n" + records)
    rows = read_table(spark, path)
    assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()
    stored = readers.materialize
    monkeypatch.setattr(readers, "materialize", lambda df, label: stored(df, label, group_rows=20))
    small = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in small}
    try:
        source = read_dataset(spark, path)
        for name, value in small.items():
            spark.conf.set(name, value)
        assert source.rows.rdd.getNumPartitions() > 3
        found = [(r[ROW_INDEX], r.text) for r in indexed(source).collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == [(i, f"{i}\nlines") for i in range(300)]
