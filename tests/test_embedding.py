"""Embedding with retries and the cache, against fake services."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from textcurate.functions.text import cache_key
from textcurate.operators import embed
from textcurate.operators.cache import EmbeddingCache, attach_vectors, with_key
from textcurate.operators.embed import (
    EmbedConfig,
    HashedEmbedder,
    NaNEmbeddingError,
    ServiceError,
    fill_cache,
    request,
)
from textcurate.plans.scratch import materialize
from textcurate.schema import KEY, ROW_INDEX, VECTOR
from textcurate.streaming.incremental import embed_new_files

CONFIG = EmbedConfig("m", batch_size=2, retry_delays=(0.0, 0.0, 0.0))


class Service:
    """Answers with the given events in turn, then with vectors."""

    def __init__(self, *events):
        self.events, self.calls = list(events), []

    def __call__(self, texts):
        self.calls.append(texts)
        if self.events:
            event = self.events.pop(0)
            if isinstance(event, Exception):
                raise event
        return [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts)))]


def test_replies_are_put_in_order():
    assert request(Service(), ["a", "bbb", "cc"], ()) == [[1.0], [3.0], [2.0]]


@pytest.mark.parametrize("error", [ServiceError(500), ServiceError(503), TimeoutError(), ConnectionError()])
def test_passing_errors_are_retried(error):
    waits, service = [], Service(error, error)
    assert request(service, ["a"], (5.0, 20.0, 60.0), waits.append) == [[1.0]]
    assert waits == [5.0, 20.0] and len(service.calls) == 3


def test_retries_end():
    waits, service = [], Service(*[ServiceError(500)] * 9)
    with pytest.raises(RuntimeError, match="after 4 attempts"):
        request(service, ["a"], (5.0, 20.0, 60.0), waits.append)
    assert waits == [5.0, 20.0, 60.0] and len(service.calls) == 4


@pytest.mark.parametrize("error", [ServiceError(400), NaNEmbeddingError("x"), ValueError("x")])
def test_other_errors_are_not_retried(error):
    service = Service(error)
    with pytest.raises(type(error)):
        request(service, ["a"], (5.0,), lambda _: pytest.fail("waited"))
    assert len(service.calls) == 1


def test_a_missing_reply_is_an_error():
    with pytest.raises(RuntimeError, match="1 vectors for 2 texts"):
        request(lambda texts: [[1.0]], ["a", "b"], ())


def rows_of(spark, texts, model="m"):
    data = list(enumerate(texts))
    return with_key(spark.createDataFrame(data, f"{ROW_INDEX} bigint, text string"), "text", model)


def length_service():
    # Local functions travel to the workers by value.
    def embed(texts):
        return [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(texts)))]

    return embed


def vectors(spark, texts, cache, model="m"):
    attached, dim = attach_vectors(rows_of(spark, texts, model), cache, model)
    return [r[VECTOR] for r in attached.orderBy(ROW_INDEX).collect()], dim


def test_cold_then_warm(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    texts = ["a", "bb", "a", "…", "ccc"]
    cold = fill_cache(rows_of(spark, texts), "text", cache, length_service(), CONFIG)
    assert cold == {"rows": 5, "hits": 0, "fresh_rows": 5, "fresh_keys": 4}
    # The ellipsis is spelled out for the model only.
    assert vectors(spark, texts, cache) == ([[1, 1], [2, 1], [1, 1], [3, 1], [3, 1]], 2)
    warm = fill_cache(rows_of(spark, texts), "text", cache, None, CONFIG)
    assert warm == {"rows": 5, "hits": 5, "fresh_rows": 0, "fresh_keys": 0}
    more = fill_cache(rows_of(spark, texts + ["dddd", "dddd"]), "text", cache, length_service(), CONFIG)
    assert more == {"rows": 7, "hits": 5, "fresh_rows": 2, "fresh_keys": 1}
    assert [tuple(r) for r in cache.stats().collect()] == [("m", 2, 5)]


def test_models_do_not_share_entries(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    fill_cache(rows_of(spark, ["a"]), "text", cache, length_service(), CONFIG)
    other = EmbedConfig("org/other:1", retry_delays=())
    assert fill_cache(rows_of(spark, ["a"], other.model), "text", cache, HashedEmbedder(4), other)["fresh_keys"] == 1
    assert vectors(spark, ["a"], cache, other.model)[1] == 4
    assert vectors(spark, ["a"], cache)[1] == 2


def test_the_newest_entry_wins(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    for value, moment in ((1.0, "2024-01-01"), (3.0, "2024-01-03"), (2.0, "2024-01-02")):
        key = spark.range(1).select(cache_key("m", F.lit("a")).alias("key"))
        cache.append(
            key.withColumns(
                {
                    "dim": F.lit(1),
                    "vector": F.array(F.lit(value).cast("float")),
                    "status": F.lit("ok"),
                    "written_at": F.lit(moment).cast("timestamp"),
                    "model": F.lit("m"),
                }
            )
        )
    assert vectors(spark, ["a"], cache) == ([[3.0]], 1)
    assert cache.stats().first()["rows"] == 1


def test_mixed_dimensions_are_an_error(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    for dim, text in ((2, "a"), (3, "b")):
        fill_cache(rows_of(spark, [text]), "text", cache, HashedEmbedder(dim), CONFIG)
    with pytest.raises(ValueError, match="2 to 3 dimensions"):
        vectors(spark, ["a"], cache)


def test_nan_becomes_a_zero_vector_of_the_right_length(spark, tmp_path):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise NaNEmbeddingError("NaN")
        return [[1.0, 2.0, 3.0]] * len(texts)

    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    texts = ["bad one", "good", "fine", "bad two"]
    fill_cache(rows_of(spark, texts), "text", cache, embed, CONFIG)
    assert vectors(spark, texts, cache) == ([[0] * 3, [1, 2, 3], [1, 2, 3], [0] * 3], 3)
    assert cache.read().filter("status = 'nan'").count() == 2


def test_nan_only_has_the_default_length(spark, tmp_path):
    def embed(texts):
        raise NaNEmbeddingError("NaN")

    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    fill_cache(rows_of(spark, ["a"]), "text", cache, embed, EmbedConfig("m", batch_size=1))
    found, dim = vectors(spark, ["a"], cache)
    assert dim == 1024 and found == [[0.0] * 1024]


def test_nothing_to_embed(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    assert fill_cache(rows_of(spark, ["x"]).limit(0), "text", cache, None, CONFIG)["rows"] == 0
    assert vectors(spark, ["x"], cache) == ([None], 0)


def test_progress_survives_a_failure(spark, tmp_path):
    """Slices are committed one by one; the second run embeds only what the first one did not reach."""
    texts = [f"text {i}" for i in range(40)] + ["poison"]
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    config = EmbedConfig("m", batch_size=4, retry_delays=(), commit_rows=8)

    def embed(batch):
        if "poison" in batch:
            raise ValueError("poison")
        return [[1.0]] * len(batch)

    with pytest.raises(Exception, match="poison"):
        fill_cache(rows_of(spark, texts), "text", cache, embed, config)
    done = cache.read().count()
    again = fill_cache(rows_of(spark, texts), "text", cache, lambda batch: [[1.0]] * len(batch), config)
    assert again["hits"] == done and again["fresh_keys"] == 41 - done
    assert cache.read().count() == 41


def test_progress_is_reported(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    fill_cache(rows_of(spark, ["a", "a"]), "text", cache, HashedEmbedder(4), CONFIG)
    seen, texts = [], ["a", "a", "a"] + [f"t{i % 9}" for i in range(18)]
    config = EmbedConfig("m", commit_rows=3)
    fill_cache(rows_of(spark, texts), "text", cache, HashedEmbedder(4), config, lambda *state: seen.append(state))
    assert seen[0] == (3, 21) and seen[-1] == (21, 21) and len(seen) == 4
    assert seen == sorted(seen)


def test_a_text_shared_by_many_rows_is_embedded_once(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias(ROW_INDEX), F.expr("IF(id % 3 = 0, 'hot', string(id))").alias("text"))
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    counts = fill_cache(with_key(rows, "text", "m"), "text", cache, HashedEmbedder(8), EmbedConfig("m"))
    assert counts["fresh_rows"] == 3000 and counts["fresh_keys"] == 2001


def test_hashed_embedder_is_a_scaled_bag_of_words():
    vector = HashedEmbedder(8)(["B, a b_a!"])[0]
    import hashlib

    def bucket(w):
        return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8

    assert sorted(set(vector.nonzero()[0].tolist())) == sorted({bucket("a"), bucket("b")})
    assert abs(float((vector * vector).sum()) - 1) < 1e-6
    assert HashedEmbedder(8)([" ,.", ""])[1].tolist() == [0.0] * 8


def test_streaming_embeds_new_files_only(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))

    def arrive(texts):
        data = spark.createDataFrame([(t,) for t in texts], "text string")
        data.coalesce(1).write.mode("append").parquet(folder)

    def run(embedder):
        return embed_new_files(
            spark, folder, "text string", "text", cache, embedder, CONFIG, checkpoint, files_per_batch=1
        )

    arrive(["a", "b", None])
    arrive(["b", "c"])
    assert run(HashedEmbedder(4)) == 2
    assert cache.read().count() == 3
    arrive(["a", "c"])
    assert run(None) == 1
    arrive(["d"])
    assert run(HashedEmbedder(4)) == 1
    assert cache.read().count() == cache.keys("m").count() == 4


def test_streams_of_csv_and_json_follow_the_readers(spark, tmp_path):
    wanted = {"a, b", "line\nbreak", 'say "hi"', "z"}
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "1.csv").write_text('text,n\n"a, b",1\n"line\nbreak",2\nNA,3\n', "utf-8")
    (folder / "2.csv").write_text('text,n\n"say ""hi""",1\n,2\nz,3\n', "utf-8")
    lines = tmp_path / "json"
    lines.mkdir()
    (lines / "1.jsonl").write_text("\n".join(json.dumps({"text": t, "n": 1}) for t in sorted(wanted)) + "\n", "utf-8")
    for number, (path, kind, options) in enumerate(
        [(folder, "csv", None), (lines, "json", None), (folder, "csv", {"recursiveFileLookup": True})]
    ):
        cache = EmbeddingCache(spark, str(tmp_path / f"cache{number}"))
        batches = embed_new_files(
            spark, str(path), "text string, n int", "text", cache, HashedEmbedder(4), CONFIG,
            str(tmp_path / f"seen{number}"), kind, 1, options,
        )
        assert batches == len(list(path.iterdir()))
        keys = {r[KEY] for r in rows_of(spark, sorted(wanted)).collect()}
        assert {r[KEY] for r in cache.keys("m").collect()} == keys


def test_compaction_keeps_the_newest_entry_of_every_key(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    fill_cache(rows_of(spark, ["a", "b", "c"]), "text", cache, HashedEmbedder(4), CONFIG)
    again = cache.read().filter(F.col("key") == rows_of(spark, ["a"]).first()[KEY]).collect()[0].asDict()
    for value in (5.0, 6.0):  # two of the same moment: any reader picks the same one
        entry = {**again, "vector": [value] * 4, "written_at": datetime.datetime(2100, 1, 1)}
        cache.append(spark.createDataFrame([entry], cache.read().schema))
    small = cache.compact(str(tmp_path / "small"))
    assert small.read().count() == 3 and cache.read().count() == 5
    assert sorted(map(tuple, small.for_model("m").select("key", "vector").collect())) == sorted(
        map(tuple, cache.for_model("m").select("key", "vector").collect())
    )
    assert EmbeddingCache(spark, str(tmp_path / "none")).compact(str(tmp_path / "empty")).read().count() == 0


def test_keys_match_across_the_package(spark):
    assert rows_of(spark, ["a"]).first()[KEY] == spark.range(1).select(cache_key("m", F.lit("a"))).first()[0]


def test_remembered_tokens_are_few():
    embed._buckets.cache_clear()
    embed.HashedEmbedder(8)([" ".join(f"t{i}" for i in range(embed.MAX_TOKENS + 10)) + " " + "z" * (embed.LONG_TOKEN + 1)])
    table = embed._buckets(8)
    assert 0 < len(table) <= embed.MAX_TOKENS and max(map(len, table)) <= embed.LONG_TOKEN
    embed._buckets.cache_clear()


def test_one_slice_is_not_stored_and_a_commit_has_one_index_file(spark, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(embed, "materialize", lambda df, label, **how: stored.append(label) or materialize(df, label, **how))
    rows = with_key(spark.createDataFrame([(str(i % 50),) for i in range(90)], "text string"), "text", "m").repartition(3)
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    counts = embed.fill_cache(rows, "text", cache, embed.HashedEmbedder(4), embed.EmbedConfig("m", batch_size=4), size=90)
    assert counts["fresh_keys"] == 50 and cache.read().count() == 50
    assert "pending" not in stored
    folder, = (tmp_path / "cache" / "index").iterdir()
    assert len(list(folder.glob("*.parquet"))) == 1
    stored.clear()
    cache = EmbeddingCache(spark, str(tmp_path / "other"))
    config = embed.EmbedConfig("m", batch_size=4, commit_rows=20)
    embed.fill_cache(rows, "text", cache, embed.HashedEmbedder(4), config, size=90)
    assert "pending" in stored and cache.read().count() == 50
