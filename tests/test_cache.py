"""Commits, index and lookups of the embedding cache."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcurate.operators import cache as caching
from textcurate.operators.cache import EmbeddingCache, with_key
from textcurate.operators.embed import EmbedConfig, HashedEmbedder, embed_texts, fill_cache
from textcurate.schema import KEY
from textcurate.streaming.incremental import embed_new_files

CONFIG = EmbedConfig("m", batch_size=50)


def texts(spark, first, last):
    return with_key(spark.range(first, last).select(F.concat(F.lit("text "), F.col("id")).alias("text")), "text", "m")


def entries(rows, files):
    return embed_texts(caching.by_prefix(rows, KEY, files), HashedEmbedder(4), CONFIG)


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """Two commits of 64 and 32 files, 12,000 entries."""
    cache = EmbeddingCache(spark, str(tmp_path_factory.mktemp("cache") / "c"))
    cache.append(entries(texts(spark, 0, 10_000), 64))
    cache.append(entries(texts(spark, 10_000, 12_000), 32))
    return cache


def test_bloom_filters_have_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (1, 50, 3000):
        h1, h2 = rng.integers(-(2**63), 2**63 - 1, (2, n))
        bloom = caching._bloom(h1, h2)
        assert all(caching._may_hold(bloom, h1[k : k + 1], h2[k : k + 1]) for k in range(n))
        other = rng.integers(-(2**63), 2**63 - 1, (2, 2000))
        wrong = sum(caching._may_hold(bloom, other[0][k : k + 1], other[1][k : k + 1]) for k in range(2000))
        assert wrong < 20


def test_a_lookup_opens_only_files_that_may_match(spark, many_files, monkeypatch):
    monkeypatch.setattr(caching, "FEW_ENTRIES", 0)
    assert many_files._index().agg(F.count("*"), F.sum("n")).first() == (96, 12_000)
    assert sorted(many_files.commits().values()) == [2000, 10_000]
    one = texts(spark, 77, 78)
    assert len(many_files.files_for("m", one)) <= 2
    assert [r[0] for r in many_files.keys("m", one).join(one, KEY, "left_semi").collect()] == [one.first()[KEY]]
    # Keys of the small commit alone: its 32 files, and few of the others by chance.
    few = texts(spark, 10_000, 11_000)
    files = many_files.files_for("m", few)
    assert 32 <= len(files) < 50
    assert many_files.keys("m", few).join(few, KEY, "left_semi").count() == 1000
    read = many_files.for_model("m", few.select(KEY))
    assert set(read.inputFiles()) <= {f"file://{f}" for f in files} and read.count() == 1000
    # A thousand keys that no file holds open almost none.
    assert len(many_files.files_for("m", texts(spark, 50_000, 51_000))) < 60
    assert len(many_files.files_for("m", texts(spark, 50_000, 50_001))) <= 1
    assert many_files.files_for("other model", few) == []
    assert many_files.keys("other model", few).count() == 0
    monkeypatch.setattr(caching, "FEW_FILES", 10)
    assert many_files.files_for("m", few) is None
    assert many_files.keys("m", few).join(few, KEY, "left_semi").count() == 1000


def test_compaction_leaves_few_files_of_prefix_runs(spark, many_files, tmp_path, monkeypatch):
    monkeypatch.setattr(caching, "FILE_ENTRIES", 1500)
    small = many_files.compact(str(tmp_path / "small"))
    runs = sorted((r.low, r.high) for r in small._index().collect())
    assert len(runs) == 8 and all(a[1] < b[0] for a, b in zip(runs, runs[1:]))
    assert small.keys("m").count() == 12_000
    with pytest.raises(FileExistsError):
        many_files.compact(str(tmp_path / "small"))


def test_a_named_commit_happens_once(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "c"))
    cache.append(entries(texts(spark, 0, 20), 2), "one")
    calls = spark.sparkContext.accumulator(0)

    def embedder(batch):
        calls.add(1)
        return [[1.0]] * len(batch)

    cache.append(embed_texts(texts(spark, 0, 20), embedder, CONFIG), "one")
    assert calls.value == 0 and cache.read().count() == 20 and cache.commits() == {"one": 20}


def test_half_written_commits_are_not_seen(spark, tmp_path, monkeypatch):
    """A failure between writing and publishing: readers see nothing of it, and the next run ends with each entry once."""
    cache = EmbeddingCache(spark, str(tmp_path / "c"))
    publish = EmbeddingCache._publish

    def fail(self, commit, n):
        raise OSError("lost")

    monkeypatch.setattr(EmbeddingCache, "_publish", fail)
    with pytest.raises(OSError):
        fill_cache(texts(spark, 0, 30), "text", cache, HashedEmbedder(4), CONFIG, commit="job")
    assert os.listdir(f"{cache.path}/data") == ["job-0"]
    assert cache.read().count() == cache.keys("m").count() == 0 and cache.dim("m") is None
    monkeypatch.setattr(EmbeddingCache, "_publish", publish)
    counts = fill_cache(texts(spark, 0, 30), "text", cache, HashedEmbedder(4), CONFIG, commit="job")
    assert counts["fresh_keys"] == 30 and cache.commits() == {"job-0": 30} and cache.read().count() == 30


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_a_stream_resumes_after_a_failure(spark, tmp_path, monkeypatch, fails_at):
    """The first batch fails while publishing its first or second slice, or its last note; the next run completes it."""
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    cache = EmbeddingCache(spark, str(tmp_path / "c"))
    config = EmbedConfig("m", batch_size=5, commit_rows=20)
    spark.range(40).select(F.concat(F.lit("text "), F.col("id")).alias("text")).coalesce(1).write.parquet(folder)
    publish, seen = EmbeddingCache._publish, []

    def sometimes(self, commit, n):
        seen.append(commit)
        if len(seen) == fails_at:
            raise OSError("lost")
        publish(self, commit, n)

    calls = spark.sparkContext.accumulator(0)
    inner = HashedEmbedder(4)

    def embedder(batch):
        calls.add(len(batch))
        return inner(batch)

    def run():
        return embed_new_files(spark, folder, "text string", "text", cache, embedder, config, checkpoint)

    monkeypatch.setattr(EmbeddingCache, "_publish", sometimes)
    with pytest.raises(Exception, match="lost"):
        run()
    visible = cache.read().count()
    assert visible == sum(cache.commits().values()) and (visible == 40) == (fails_at == 3)
    embedded = calls.value
    assert run() == 1
    assert cache.read().count() == cache.keys("m").count() == 40
    # Only what was not published is embedded again.
    assert calls.value == embedded + 40 - visible
    assert run() == 0


def test_a_finished_batch_is_passed_over(spark, tmp_path):
    """Spark's checkpoint may lack a batch that the ledger has: the batch is not looked at again."""
    folder = str(tmp_path / "in")
    cache = EmbeddingCache(spark, str(tmp_path / "c"))
    spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1).write.parquet(folder)

    def run(checkpoint, embedder):
        return embed_new_files(spark, folder, "text string", "text", cache, embedder, CONFIG, checkpoint)

    checkpoint = str(tmp_path / "checkpoint")
    assert run(checkpoint, HashedEmbedder(4)) == 1
    for name in os.listdir(f"{checkpoint}/commits"):
        os.remove(f"{checkpoint}/commits/{name}")
    before = cache.commits()
    assert run(checkpoint, None) == 1 and cache.commits() == before


def test_vectors_are_exchanged_once_on_their_way_to_the_rows(spark, many_files):
    """What finds the newest entries of keys is what the join needs."""
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        entries = many_files.for_model("m").select(F.col("key").alias(KEY), "vector")
        plan = texts(spark, 0, 100).join(entries, KEY, "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("remembered", [1, 100_000])
def test_texts_are_exchanged_once(spark, monkeypatch, remembered):
    """Copies in one task and in several, more keys than a task remembers: one row a key, in runs of prefixes."""
    monkeypatch.setattr(caching, "SEEN_KEYS", remembered)
    rows = texts(spark, 0, 50).union(texts(spark, 25, 100)).union(texts(spark, 0, 100)).repartition(3)
    once = caching.once_by_prefix(rows, 4)
    plan = once._jdf.queryExecution().executedPlan().toString()
    # That of the test and that of the prefixes.
    assert plan.count("Exchange ") == 2
    found = once.withColumn("part", F.spark_partition_id()).withColumn("prefix", caching.prefix(F.col(KEY))).collect()
    assert sorted(r.text for r in found) == sorted(f"text {i}" for i in range(100))
    assert all(r.part == r.prefix * 4 // caching.PREFIXES for r in found)


@pytest.mark.parametrize("few", [200_000, 0])
def test_each_missing_text_is_embedded_once(spark, tmp_path, monkeypatch, few):
    """Nothing cached, then a part of the texts; broadcast keys and joined ones; one slice and several."""
    from textcurate.operators import embed

    monkeypatch.setattr(embed, "FEW_KEYS", few)
    rows = texts(spark, 0, 60).union(texts(spark, 30, 90))
    for slices in (1, 3):
        cache = EmbeddingCache(spark, str(tmp_path / f"c{slices}"))
        config = EmbedConfig("m", batch_size=50, commit_rows=-(-90 // slices))
        assert fill_cache(rows, "text", cache, HashedEmbedder(4), config)["fresh_keys"] == 90
        assert cache.read().count() == cache.read().select("key").distinct().count() == 90
        again = fill_cache(rows.union(texts(spark, 90, 120)), "text", cache, HashedEmbedder(4), config)
        assert (again["hits"], again["fresh_keys"]) == (120, 30) and cache.read().count() == 120
