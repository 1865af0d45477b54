"""A whole session on a small dataset of 18 sentences: load, inspect, mark, save."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcurate import finalize, load, pre_embed, prepare
from textcurate import status as session_status
from textcurate.operators import edits as editing
from textcurate.operators import project
from textcurate.operators.embed import EmbedConfig, HashedEmbedder
from textcurate.operators.rowindex import with_row_index
from textcurate.plans import dataset as plan
from textcurate.plans import skew
from textcurate.schema import ROW_INDEX, SOURCE_POSITION, VECTOR
from textcurate.sources.readers import read_dataset, read_table

CONFIG = EmbedConfig("hashed")
EMBEDDER = HashedEmbedder(1024)

SENTENCES = [
    ("Enzymes in the cell speed up the chemistry of the cell.", "biology"),
    ("Leaves turn light, water and air into sugar.", "biology"),
    ("Merge sort splits a list, sorts the halves and joins them.", "cs"),
    ("A heap keeps its smallest key at the root.", "cs"),
    ("Lisbon lies where the Tagus meets the sea.", "geography"),
    ("The Danube flows through ten countries, more than any other river.", "geography"),
    ('Win big now, "free" phones for all callers!', "spam"),
    ("Your parcel waits, pay the fee now!", "spam"),
    ("Gradient descent follows the slope of the loss.", "cs"),
    ("Genes of the cell are read into proteins by the cell.", "biology"),
    ("Osaka is a port in the west of Japan.", "geography"),
    ("blorp zint quax foo bar lorem one", "noise"),
    ("Win a free prize now, you are our lucky visitor!", "spam"),
    ("The cell divides after the cell has copied its genes.", "biology"),
    ("A stack returns the last item first.", "cs"),
    ("blorp zint quax foo bar lorem two", "noise"),
    ("blorp zint quax foo bar lorem three", "noise"),
    ("blorp zint quax foo bar lorem four", "noise"),
]


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    path = tmp_path_factory.mktemp("data") / "demo.csv"
    quoted = ['%d,"%s",%s' % (i + 1, text.replace('"', '""'), kind) for i, (text, kind) in enumerate(SENTENCES)]
    path.write_text("id,text,source\n" + "\n".join(quoted) + "\n", "utf-8")
    return str(path)


@pytest.fixture(scope="module")
def dataset(spark, source):
    return load(spark, source, EMBEDDER, CONFIG, id_column="id")


def test_cold_and_warm_load(spark, source, dataset):
    cold = dataset.summary
    assert cold["rows"] == 18 and cold["embedding_dim"] == 1024 and not cold["reduced_to_2d"]
    assert (cold["embeddings_cached_hits"], cold["embeddings_freshly_computed"]) == (0, 18)
    assert cold["columns"] == ["id", "text", "source", "keep", "flag", "notes"]
    warm = load(spark, source, None, CONFIG, reduce_to_2d=True).summary
    assert (warm["embeddings_cached_hits"], warm["embeddings_freshly_computed"]) == (18, 0)
    assert warm["reduced_to_2d"] and warm["columns"][-2:] == ["x", "y"]
    report = pre_embed(spark, source, None, CONFIG)
    assert (report["rows"], report["hits"], report["fresh"], report["embedding_dim"]) == (18, 18, 0, 1024)


def test_status(dataset):
    assert session_status(None) == {"loaded": False} and session_status(dataset) == dataset.status()
    status = dataset.status()
    assert status["loaded"] and status["rows"] == status["kept_count"] == 18
    assert status["flagged_count"] == status["noted_count"] == 0
    assert status["cache"]["rows"] == 18 and status["embedding_dim"] == 1024


def test_rows_keep_file_order(dataset):
    rows = dataset.rows.orderBy(ROW_INDEX).collect()
    assert [(r[ROW_INDEX], r.id, r.text) for r in rows] == [(i, i + 1, s) for i, (s, _) in enumerate(SENTENCES)]


def test_get_row(dataset):
    row = dataset.get_row(6).first().asDict()
    assert list(row) == ["row_index", "id", "text", "source", "keep", "flag", "notes"]
    assert row["text"] == SENTENCES[6][0]
    for bad in (-1, 18):
        with pytest.raises(IndexError, match="there is no row"):
            dataset.get_row(bad)


def test_search(dataset):
    found = dataset.search("what is in the cell", 3).collect()
    assert len(found) == 3 and SENTENCES[found[0].row_index][1] == "biology"
    assert found[0].__fields__ == ["row_index", "text", "keep", "flag", "id", "score"]
    assert found[0].score >= found[1].score >= found[2].score
    assert dataset.search("x", 0).collect() == []
    assert dataset.search("x", 500).count() == 18


def test_outliers_and_near_duplicates(dataset):
    outliers = dataset.find_outliers(4, 3).collect()
    assert len(outliers) == 4 and "outlier_score" in outliers[0].__fields__
    pairs = dataset.find_near_duplicates(0.7).collect()
    noise = {11, 15, 16, 17}
    assert len(pairs) == 6 and all({p.row_a.row_index, p.row_b.row_index} <= noise for p in pairs)
    assert pairs[0].row_a.text == SENTENCES[pairs[0].row_a.row_index][0]
    assert all(p.row_a.row_index < p.row_b.row_index for p in pairs)


def test_mark_and_save(spark, dataset, tmp_path):
    marked, counts = dataset.mark([11, 15, 16, 17], keep=False, notes="noise")
    assert counts == {"updated_rows": 4, "kept_count": 14, "flagged_count": 0, "noted_count": 4}
    marked, counts = marked.mark([6, 7, 12, 12], flag=True)
    assert counts == {"updated_rows": 4, "kept_count": 14, "flagged_count": 3, "noted_count": 4}
    assert dataset.status()["kept_count"] == 18

    kept = marked.save_kept(str(tmp_path / "kept.csv"))
    assert (kept["rows"], kept["total"]) == (14, 18)
    found = read_dataset(spark, kept["path"]).rows.drop(*SOURCE_POSITION)
    assert found.columns == ["id", "text", "source", "flag", "notes"]
    assert found.count() == 14 and found.filter("flag").count() == 3

    curated = marked.save_curated(str(tmp_path / "curated.csv"))
    again = load(spark, curated["path"], None, CONFIG, cache_path=dataset.cache.path)
    assert curated["rows"] == again.size == 18
    status = again.status()
    assert (status["kept_count"], status["flagged_count"], status["noted_count"]) == (14, 3, 4)

    assert not marked.search("blorp", 1).first().keep
    assert marked.search("blorp", 18, only_kept=True).count() == 14
    assert marked.find_near_duplicates(0.7, only_kept=True).collect() == []
    assert not {11, 15, 16, 17} & {r.row_index for r in marked.find_outliers(14, only_kept=True).collect()}

    restored, counts = marked.mark([11], keep=True)
    assert counts["kept_count"] == 15 and restored.get_row(11).first().notes == "noise"


def test_mark_rejects_bad_calls(dataset):
    with pytest.raises(IndexError, match=r"\[-1, 18\]"):
        dataset.mark([0, -1, 18], keep=False)
    with pytest.raises(ValueError, match="nothing to mark"):
        dataset.mark([0])


def test_an_edits_table(spark, dataset):
    rows = [(1, 0, False, None, None), (2, 0, None, True, "a"), (3, 0, True, None, " "), (1, 5, None, None, "x")]
    edited = dataset.mark([5], notes="old")[0].apply_edits(spark.createDataFrame(rows, editing.SCHEMA))
    found = {r[ROW_INDEX]: (r.keep, r.flag, r.notes) for r in edited.current().collect()}
    assert found[0] == (True, True, " ") and found[5] == (True, False, "x") and found[1] == (True, False, "")
    assert edited.status()["noted_count"] == 1
    later, _ = edited.mark([5], notes="y")
    assert later.get_row(5).first().notes == "y"
    wrong = [(1, -3, True, None, None), *[(1, 18 + k, True, None, None) for k in range(250)]]
    with pytest.raises(editing.RowsOutOfRange, match="251 row indices") as raised:
        dataset.apply_edits(spark.createDataFrame(wrong, editing.SCHEMA))
    assert {r[0] for r in raised.value.rows.collect()} == {-3, *range(18, 268)}


def test_many_marks_stay_one_scan(spark, dataset, monkeypatch):
    monkeypatch.setattr(plan, "LOG_FILES", 4)
    marked = dataset
    for number in range(10):
        before = marked
        marked, counts = marked.mark([number], keep=False, notes=f"mark {number}")
        assert counts["kept_count"] == 17 - number and len(marked.edit_log) < 4
    assert before.status()["kept_count"] == 9 and dataset.edits is None
    found = {r[ROW_INDEX]: r.notes for r in marked.current().collect()}
    assert found == {i: f"mark {i}" if i < 10 else "" for i in range(18)}
    assert marked.edits.count() == marked.edit_count == 10


def test_reports_of_any_size_are_the_same(dataset, monkeypatch):
    marked, _ = dataset.mark([11], keep=False, notes="noise")

    def reports():
        return (
            marked.search("the cell", 18).collect(),
            marked.find_outliers(10, 3).collect(),
            marked.find_near_duplicates(0.1, 100).collect(),
        )

    listed = reports()
    monkeypatch.setattr(plan, "FEW_ROWS", 2)
    assert reports() == listed


@pytest.mark.parametrize("few", [0, 200_000])
def test_saved_files_keep_the_order_of_rows(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(editing, "FEW_EDITS", few)
    source = tmp_path / "uneven.parquet"
    start = 0
    for part, size in enumerate((10, 250, 40, 100)):
        rows = spark.range(start, start + size, 1, 1).selectExpr("id", "concat('text ', id, repeat(' more', 200)) AS text")
        rows.write.mode("append").parquet(str(tmp_path / f"part{part}"))
        for file in (tmp_path / f"part{part}").glob("*.parquet"):
            source.mkdir(exist_ok=True)
            (source / f"part-{part}.parquet").write_bytes(file.read_bytes())
        start += size
    config = EmbedConfig("hashed-16")
    data = load(spark, str(source), HashedEmbedder(16), config, id_column="id", cache_path=str(tmp_path / "cache"))
    data, _ = data.mark([3, 300], keep=False)
    data, _ = data.project_2d()
    kept = data.save_kept(str(tmp_path / "kept.parquet"))["path"]
    assert [r.id for r in with_row_index(read_table(spark, kept)).orderBy(ROW_INDEX).collect()] == [
        i for i in range(400) if i not in (3, 300)
    ]
    for path in (data.save_curated(str(tmp_path / "c.csv"))["path"], data.write_template(str(tmp_path / "t.csv"))["path"]):
        assert [r.id for r in with_row_index(read_table(spark, path)).orderBy(ROW_INDEX).collect()] == list(range(400))
    final = finalize(spark, str(source), str(tmp_path / "t.csv"), str(tmp_path / "final.jsonl"))["path"]
    found = with_row_index(read_table(spark, final)).orderBy(ROW_INDEX).collect()
    assert [r.id for r in found] == [i for i in range(400) if i not in (3, 300)]


def test_a_warm_load_looks_for_misses_while_it_attaches(spark, tmp_path):
    """All texts known, one unknown, and none known: the same vectors and counts as filling the cache first gives."""
    path, cache = str(tmp_path / "a.jsonl"), str(tmp_path / "cache")

    def write(texts):
        with open(path, "w") as out:
            out.writelines(json.dumps({"text": t}) + "\n" for t in texts)

    def loaded(embedder):
        seen = []
        data = load(spark, path, embedder, CONFIG, cache_path=cache, on_progress=lambda *x: seen.append(x))
        counts = [data.summary[k] for k in ("rows", "embeddings_cached_hits", "embeddings_freshly_computed")]
        return {r[ROW_INDEX]: list(r[VECTOR]) for r in data.vectors.collect()}, counts, seen, data.dim

    write(["a", "b", "a", "c d"])
    cold, counts, seen, dim = loaded(EMBEDDER)
    assert counts == [4, 0, 4] and seen[-1] == (4, 4) and dim == 1024
    again, counts, seen, dim = loaded(None)
    assert again == cold and counts == [4, 4, 0] and seen == [(4, 4)] and dim == 1024
    write(["a", "b", "a", "c d", "new"])
    more, counts, seen, _ = loaded(EMBEDDER)
    assert counts == [5, 4, 1] and seen == [(4, 5), (5, 5)] and {k: more[k] for k in cold} == cold
    assert more[4] == [float(x) for x in EMBEDDER(["new"])[0]]


@pytest.mark.parametrize("parts", [1, 5])
def test_projection_equals_brute_force(spark, tmp_path, parts):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(60, 7)) * np.arange(1, 8) + 0.5
    rows[5] = 0
    data = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{ROW_INDEX} long, {VECTOR} array<float>")
    units = rows.astype(np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True) + 1e-12
    centred = units - units.mean(axis=0)
    _, spread, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2] * np.sign(axes[:2][np.arange(2), np.abs(axes[:2]).argmax(axis=1)])[:, None]
    placed = {r[ROW_INDEX]: (r.x, r.y) for r in project.project_2d(data.repartition(parts)).collect()}
    found = np.array([placed[i] for i in range(60)])
    assert np.allclose(found, centred @ axes.T, atol=1e-6)
    assert np.allclose(found.var(axis=0), spread[:2] ** 2 / 60)
    # Stored axes place a row as it was placed, and rows they have not seen.
    project.principal_axes(data).save(spark, str(tmp_path / "axes"))
    again = project.Axes.load(spark, str(tmp_path / "axes")).place(data.filter(f"{ROW_INDEX} = 9")).first()
    assert abs(again.x - placed[9][0]) < 1e-9 and abs(again.y - placed[9][1]) < 1e-9
    with pytest.raises(ValueError):
        project.project_2d(data.limit(0))


def test_projection(spark, dataset):
    placed, ranges = dataset.project_2d()
    assert ranges["rows"] == 18 and ranges["x_range"][0] < 0 < ranges["x_range"][1]
    frame = placed.scatter_frame().collect()
    assert {r.color for r in frame} == {"biology", "cs", "geography", "spam", "noise"}
    assert len(frame[0].embedding) == 1024
    again = dataset.vectors.repartition(5, F.col(ROW_INDEX))
    from textcurate.operators.project import project_2d

    other = {r[ROW_INDEX]: (r.x, r.y) for r in project_2d(again).collect()}
    for r in placed.coordinates.collect():
        assert abs(r.x - other[r[ROW_INDEX]][0]) < 1e-9 and abs(r.y - other[r[ROW_INDEX]][1]) < 1e-9
    # The four noise lines are almost the same, so they lie together.
    noise = [other[i] for i in (11, 15, 16, 17)]
    spread = max(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a in noise for b in noise)
    assert spread < 0.25 * (ranges["x_range"][1] - ranges["x_range"][0])
    with pytest.raises(ValueError, match="at least 3 rows"):
        project_2d(dataset.vectors.limit(2))


def test_the_edited_file_round(spark, source, tmp_path):
    copy = tmp_path / "demo.csv"
    copy.write_text(open(source, encoding="utf-8").read(), "utf-8")
    prepared, template = prepare(spark, str(copy), EMBEDDER, CONFIG)
    assert template == str(tmp_path / "demo.curated.csv") and prepared.coordinates is not None
    written = read_table(spark, template).drop(*SOURCE_POSITION)
    assert written.columns == ["id", "text", "source", "keep", "flag", "notes"]
    word = F.expr("CASE id WHEN 1 THEN 'no' WHEN 2 THEN ' YES' WHEN 3 THEN NULL WHEN 4 THEN '0' ELSE 'true' END")
    edited = str(tmp_path / "edited.csv")
    written.withColumn("keep", word).write.option("header", True).option("escape", '"').csv(edited)
    result = finalize(spark, str(copy), curated=edited)
    assert result == {"path": str(tmp_path / "demo.kept.csv"), "rows": 16, "total": 18}
    kept = read_table(spark, result["path"])
    assert "keep" not in kept.columns and sorted(r.id for r in kept.collect()) == [2, 3, *range(5, 19)]


def test_user_columns_named_like_coordinates_survive(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(json.dumps({"text": f"t {i}", "x": i, "embedding": "e"}) for i in range(4)), "utf-8")
    data = load(spark, str(path), EMBEDDER, CONFIG)
    saved = data.save_kept()
    assert saved["path"] == str(tmp_path / "a.kept.jsonl")
    assert {r.x for r in read_table(spark, saved["path"]).collect()} == {0, 1, 2, 3}


def test_join_on_unique_with_hot_keys(spark):
    left = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', string(id % 500)) AS k")
    right = spark.createDataFrame([("hot", 1), ("7", 2), ("8", 3)], "k string, v int")
    assert skew.hot_keys(left, "k", min_rows=100) == ["hot"]
    for how in ("inner", "left"):
        split = skew.join_on_unique(left, right, "k", how, min_rows=100)
        plain = left.join(right, "k", how)
        assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
