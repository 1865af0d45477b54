
from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

from textcurate.functions.text import cache_key, coerce_bool, normalize_text, row_json  # noqa: E402
from textcurate.functions.vectors import cosine_to  # noqa: E402
from textcurate.operators import edits as editing  # noqa: E402
from textcurate.operators import inspect, lsh, project, similarity, sparse  # noqa: E402
from textcurate.operators.cache import EmbeddingCache, attach_vectors, misses, probe, with_key  # noqa: E402
from textcurate.operators.embed import EmbedConfig, HashedEmbedder, NaNEmbeddingError, fill_cache  # noqa: E402
from textcurate.operators.rowindex import with_row_index  # noqa: E402
from textcurate.plans.dataset import Dataset, load  # noqa: E402
from textcurate.plans.jobs import finalize, pre_embed  # noqa: E402
from textcurate.plans.shipping import ship  # noqa: E402
from textcurate.plans.scratch import materialize, scratch_path  # noqa: E402
from textcurate.schema import KEY, ROW_INDEX, SOURCE_POSITION, VECTOR, ensure_curation_columns  # noqa: E402
from textcurate.sources.documents import docx_texts, extract_parts  # noqa: E402
from textcurate.sources.plaintext import read_plaintext, split_paragraphs  # noqa: E402
from textcurate.sources.readers import choose_text_column, read_dataset, read_parquet  # noqa: E402
from textcurate.sources.writers import write_table  # noqa: E402
from textcurate.streaming.incremental import embed_new_files  # noqa: E402

try:
    import corpus_pipeline
    from textcurate.llm import queries as llm_queries
except ImportError as missing:  # the training-data operators are an optional part
    there = (ROOT / "corpus_pipeline.py").exists() and (ROOT / "textcurate" / "llm" / "__init__.py").exists()
    if there and (missing.name or "").startswith(("textcurate", "corpus_pipeline")):
        raise  # not absent but broken
    corpus_pipeline = llm_queries = None

MODEL = "hashed-256"
DIM = 256
CONFIG = EmbedConfig(MODEL)
EMBEDDER = HashedEmbedder(DIM)

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as curation rows; ``doc_id`` is their position in the file."""
    rows = _table(spark, sf_dir, "documents").withColumn(ROW_INDEX, F.col("doc_id"))
    return ensure_curation_columns(rows)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias(ROW_INDEX), F.col("embedding").alias(VECTOR))


def _fresh_cache(spark: SparkSession) -> EmbeddingCache:
    return EmbeddingCache(spark, scratch_path(spark, "cache"))


def _document_vectors(spark: SparkSession, sf_dir: str, embedder=EMBEDDER, config=CONFIG) -> DataFrame:
    rows = with_key(_documents(spark, sf_dir).select(ROW_INDEX, "text"), "text", MODEL)
    cache = _fresh_cache(spark)
    fill_cache(rows, "text", cache, embedder, config)
    return attach_vectors(rows.drop("text"), cache, MODEL)[0].select(ROW_INDEX, VECTOR)


def _labelled_cache(spark: SparkSession, sf_dir: str) -> EmbeddingCache:
    """A cache that holds the texts of the documents in ``labels``."""
    cache = _fresh_cache(spark)
    labelled = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    fill_cache(with_key(labelled.select("text"), "text", MODEL), "text", cache, EMBEDDER, CONFIG)
    return cache


def _load_documents(spark: SparkSession, sf_dir: str, cache: EmbeddingCache | None = None) -> Dataset:
    path = (cache or _fresh_cache(spark)).path
    return load(spark, f"{sf_dir}/documents.parquet", EMBEDDER, CONFIG, id_column="doc_id", cache_path=path)


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are dropped, poor ones flagged, and toxic ones of good quality restored, in this order."""
    labels = _table(spark, sf_dir, "labels").withColumn(ROW_INDEX, F.col("doc_id"))

    def step(seq: int, where: str, keep: bool | None, flag: bool | None, notes: str | None) -> DataFrame:
        return labels.filter(where).select(
            F.lit(seq).cast("bigint").alias("seq"),
            ROW_INDEX,
            F.lit(keep).cast("boolean").alias("keep"),
            F.lit(flag).cast("boolean").alias("flag"),
            F.lit(notes).cast("string").alias("notes"),
        )

    return (
        step(1, "toxic = 1", False, None, "toxic")
        .unionByName(step(2, "quality = 0", None, True, "low quality"))
        .unionByName(step(3, "toxic = 1 AND quality = 1", True, None, None))
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- sources


def q_load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = read_dataset(spark, f"{sf_dir}/documents.parquet")
    rows = with_row_index(ensure_curation_columns(source.rows))
    return rows.withColumnRenamed(ROW_INDEX, "row_index")


def q_row_index_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_row_index(_table(spark, sf_dir, "conversations"), order_by=["conv_id", "turn"])
    return rows.select(F.col(ROW_INDEX).alias("row_index"), "conv_id", "turn")


def q_detect_text_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for name, requested in (("pages", "text"), ("conversations", "prompt"), ("documents", "source")):
        found.append((name, choose_text_column(read_parquet(spark, f"{sf_dir}/{name}.parquet"), requested)))
    return spark.createDataFrame(found, "table_name string, text_column string")


def _round_trip(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    target = scratch_path(spark, "round-trip") + suffix
    write_table(_table(spark, sf_dir, "documents"), target)
    rows = read_dataset(spark, target).rows
    return rows.select("doc_id", "text", "lang", "source", "n_chars")


def q_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, ".csv")


def q_json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, ".jsonl")


def q_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, ".json")


def q_json_with_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines under ``.json``, read by a schema that is known beforehand."""
    rows = _table(spark, sf_dir, "documents")
    target = scratch_path(spark, "typed") + ".json"
    write_table(rows, target)
    return read_dataset(spark, target, schema=rows.schema).rows.drop(*SOURCE_POSITION)


def q_csv_long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of 19 digits, which a double cannot hold, and numbers too long for 64 bits, which stay as they are spelled."""
    rows = _table(spark, sf_dir, "documents")
    long_id = F.lit(1234567890123456000) + F.col("doc_id")
    rows = rows.select("doc_id", "text", long_id.alias("long_id"), F.concat(long_id.cast("string"), F.lit("789")).alias("longer"))
    target = scratch_path(spark, "long-ids") + ".csv"
    write_table(rows, target)
    return read_dataset(spark, target).rows.drop("text", *SOURCE_POSITION)


def _spaced(text) -> F.Column:
    return F.replace(text, F.lit(".\n"), F.lit(".\r\n\r\n"))


def q_text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.posexplode(split_paragraphs(_spaced(F.col("text")))).alias("part", "text"))


def q_plaintext_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "texts") + ".txt"
    _table(spark, sf_dir, "documents").select(F.concat(_spaced(F.col("text")), F.lit("\n"))).write.text(target)
    return read_plaintext(spark, target).select("text")


# Functions that run on the workers are made inside others: they then travel by value, as workers cannot import
# this file.


def _docx_maker():
    """A minimal word-processing file with one paragraph per line of each text."""

    @F.arrow_udf(T.BinaryType())
    def as_docx(texts: pa.Array) -> pa.Array:
        files = []
        for text in texts.to_pylist():
            paragraphs = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
            space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as archive:
                xml = f'<w:document xmlns:w="{space}"><w:body>{paragraphs}</w:body></w:document>'
                archive.writestr("word/document.xml", xml)
            files.append(buffer.getvalue())
        return pa.array(files, pa.binary())

    return as_docx


def q_docx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    files = rows.select(F.col("doc_id").cast("string").alias("path"), _docx_maker()("text").alias("content"))
    parts = extract_parts(files, docx_texts)
    return parts.select(F.col("__file").cast("bigint").alias("doc_id"), F.col("__part").alias("part"), "text")


def q_paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    content = F.encode(F.replace("text", F.lit("\n"), F.lit("\f")), "UTF-8")
    files = rows.select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    pages = extract_parts(files, lambda content: content.decode("utf-8").split("\f"))
    return pages.select(F.col("__file").cast("bigint").alias("doc_id"), (F.col("__part") + 1).alias("page"), "text")


# ---- projections and predicates


def q_row_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.preview(_documents(spark, sf_dir), "text", "doc_id")


def q_row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias(ROW_INDEX))
    return inspect.get_rows(_documents(spark, sf_dir), wanted)


def q_row_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Values of nothing become NaN here, so that the null rule has something to do.
    events = _table(spark, sf_dir, "events").select(
        "event_id",
        # Whatever the session's zone, the table's time of day is written.
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("event_type") != "click", F.col("user_id")).alias("user_id"),
        "event_type",
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        "props",
    )
    return events.select("event_id", row_json(events.schema).alias("json"))


def q_coerce_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    word = F.when(F.col("quality") == 1, " Yes\t").otherwise("no")
    blank = F.when(F.col("toxic") == 1, F.lit("drop"))
    return labels.select(
        "doc_id",
        coerce_bool(F.col("quality"), T.IntegerType()).alias("from_int"),
        coerce_bool(F.col("quality").cast("double") / 2, T.DoubleType()).alias("from_double"),
        coerce_bool(F.col("toxic") == 1, T.BooleanType()).alias("from_bool"),
        coerce_bool(word, T.StringType()).alias("from_word"),
        coerce_bool(F.col("quality").cast("string"), T.StringType()).alias("from_digit"),
        coerce_bool(blank, T.StringType()).alias("from_blank"),
    )


# ---- text, embedding, cache


def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables hold plain punctuation only, so typographic characters are planted first.
    planted = F.translate("text", ".,-' ", "…•—’ ")
    planted = F.replace(F.replace(planted, F.lit("fi"), F.lit("ﬁ")), F.lit("\n"), F.lit("→©®\n"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", planted.alias("text"))
    return rows.select("doc_id", normalize_text(F.col("text")).alias("text"))


def q_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", cache_key(MODEL, F.col("text")).alias("key"))


def q_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_key(_documents(spark, sf_dir), "text", MODEL)
    marked = probe(rows, _labelled_cache(spark, sf_dir).keys(MODEL))
    return marked.select(F.col(KEY).alias("key"), "copies", F.col("_hit").alias("hit"))


def q_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_key(_documents(spark, sf_dir), "text", MODEL)
    known = probe(rows, _labelled_cache(spark, sf_dir).keys(MODEL))
    missing = misses(rows, "text", known.filter(~F.col("_hit")).select(KEY))
    return missing.select(F.col(KEY).alias("key"), "text")


def q_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_cache(spark, sf_dir).stats()


def q_cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put a second vector of another kind under every known key; the newer one is read."""
    cache = _labelled_cache(spark, sf_dir)
    newer = F.array_repeat(F.lit(1.0).cast("float"), DIM)
    later = F.col("written_at") + F.expr("INTERVAL 1 SECOND")
    cache.append(materialize(cache.read(), "entries").withColumns({"vector": newer, "written_at": later}))
    entries = cache.for_model(MODEL)
    return entries.select("key", "dim", F.forall("vector", lambda x: x == 1).alias("replaced"))


def q_cache_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key is written twice, and once after compaction."""
    cache = _labelled_cache(spark, sf_dir)
    later = F.col("written_at") + F.expr("INTERVAL 1 SECOND")
    cache.append(materialize(cache.read(), "entries").withColumns({"status": F.lit("again"), "written_at": later}))
    compacted = cache.compact(scratch_path(spark, "compacted"))
    return compacted.read().select("key", "dim", "status", F.size("vector").alias("length"))


def q_hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(_document_vectors(spark, sf_dir))


def q_embed_one_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per request, and a service that answers with an index."""
    embedder = EMBEDDER

    def service(texts: list[str]) -> list[dict]:
        return [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(embedder(texts))))]

    return _weights(_document_vectors(spark, sf_dir, service, EmbedConfig(MODEL, batch_size=1)))


def _weights(vectors: DataFrame) -> DataFrame:
    entries = vectors.select(F.col(ROW_INDEX).alias("doc_id"), F.posexplode(VECTOR).alias("bucket", "weight"))
    return _rounded(entries.filter("weight <> 0").withColumn("weight", F.col("weight").cast("double")), "weight")


def q_nan_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedder = EMBEDDER

    def fails_on_short_texts(texts: list[str]) -> list:
        if any(len(t) < 200 for t in texts):
            raise NaNEmbeddingError("NaN")
        return embedder(texts)

    vectors = _document_vectors(spark, sf_dir, fails_on_short_texts)
    zero = F.forall(VECTOR, lambda x: x == 0)
    return vectors.select(F.col(ROW_INDEX).alias("doc_id"), F.size(VECTOR).alias("dim"), zero.alias("is_zero"))


def q_nan_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that answers short texts with NaN instead of raising an error."""
    embedder = EMBEDDER

    def answers_nan(texts: list[str]) -> list:
        return [[float("nan")] * DIM if len(t) < 200 else v for t, v in zip(texts, embedder(texts))]

    vectors = _document_vectors(spark, sf_dir, answers_nan)
    zero = F.forall(VECTOR, lambda x: x == 0)
    return vectors.select(F.col(ROW_INDEX).alias("doc_id"), F.size(VECTOR).alias("dim"), zero.alias("is_zero"))


def q_pre_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _labelled_cache(spark, sf_dir)
    report = pre_embed(spark, f"{sf_dir}/documents.parquet", EMBEDDER, CONFIG, cache_path=cache.path)
    fields = ("rows", "embedding_dim", "fresh", "hits")
    return spark.createDataFrame(
        [tuple(report[f] for f in fields)], ", ".join(f"{f} bigint" for f in fields)
    )


def q_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = _load_documents(spark, sf_dir, _labelled_cache(spark, sf_dir)).summary
    fields = {
        "rows": "bigint",
        "text_column": "string",
        "id_column": "string",
        "embedding_model": "string",
        "embedding_dim": "bigint",
        "embeddings_cached_hits": "bigint",
        "embeddings_freshly_computed": "bigint",
        "distinct_texts_embedded": "bigint",
        "reduced_to_2d": "boolean",
    }
    row = tuple(summary[f] for f in fields) + (",".join(summary["columns"]),)
    return spark.createDataFrame([row], ", ".join(f"{f} {t}" for f, t in fields.items()) + ", columns string")


def q_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _load_documents(spark, sf_dir).apply_edits(_edits(spark, sf_dir)).status()
    fields = ("rows", "embedding_dim", "kept_count", "flagged_count", "noted_count")
    row = tuple(status[f] for f in fields) + (status["cache"]["rows"], status["loaded"])
    return spark.createDataFrame([row], ", ".join(f"{f} bigint" for f in fields) + ", cache_rows bigint, loaded boolean")


def q_incremental_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as one folder per language, some files per micro-batch."""
    folder, cache = scratch_path(spark, "arriving"), _fresh_cache(spark)
    _table(spark, sf_dir, "documents").select("text", "lang").write.partitionBy("lang").parquet(folder)
    embed_new_files(
        spark, folder, "text string, lang string", "text", cache, EMBEDDER, CONFIG,
        checkpoint=scratch_path(spark, "stream"), files_per_batch=4,
    )
    return cache.read().select("key", "dim", "status")


def q_incremental_embed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as CSV with a header, quotes, and line breaks in cells."""
    folder, cache = scratch_path(spark, "arriving") + ".csv", _fresh_cache(spark)
    write_table(_table(spark, sf_dir, "documents").select("text", "lang"), folder)
    embed_new_files(
        spark, folder, "text string, lang string", "text", cache, EMBEDDER, CONFIG,
        checkpoint=scratch_path(spark, "stream"), file_format="csv", files_per_batch=4,
    )
    return cache.read().select("key", "dim", "status")


# ---- similarity


def q_cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _first_vector(spark, sf_dir)
    scored = _vectors(spark, sf_dir).select(
        F.col(ROW_INDEX).alias("vec_id"), cosine_to(F.col(VECTOR), query).alias("similarity")
    )
    return _rounded(scored, "similarity")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _table(spark, sf_dir, "embeddings").agg(F.min_by("embedding", "vec_id")).first()[0]


def q_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = similarity.search(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 20)
    return _rounded(best.select(F.col(ROW_INDEX).alias("row_index"), "score"), "score")


def q_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "benchmark").agg(F.min_by("text", "item_id")).first()[0]
    return _rounded(_load_documents(spark, sf_dir).search(query, 20), "score")


def q_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text against all documents."""
    queries = _table(spark, sf_dir, "benchmark")
    found = _load_documents(spark, sf_dir).search_table(queries, 5, id_column="item_id")
    return _rounded(found.select("query_id", "rank", "row_index", "text", "score"), "score")


def q_search_many_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of large inputs: all vectors as queries, in small blocks, against all vectors."""
    vectors = _vectors(spark, sf_dir)
    queries = vectors.withColumnRenamed(ROW_INDEX, "query_id")
    return _rounded(similarity.search_many(vectors, queries, 4, block_rows=50, direct_blocks=0), "score")


def q_near_duplicates_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lsh.near_duplicates_approximate(_document_vectors(spark, sf_dir), 0.95, 1000), "similarity")


def q_near_duplicates_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.near_duplicates(_vectors(spark, sf_dir), 0.4, 1000), "similarity")


def q_near_duplicates_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of large inputs on a small one: many cells and blocks."""
    return _rounded(similarity.near_duplicates(_vectors(spark, sf_dir), 0.4, 1000, block_rows=100, direct_blocks=0), "similarity")


def q_near_duplicates_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.near_duplicates(_document_vectors(spark, sf_dir), 0.95, 1000), "similarity")


def q_near_duplicates_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sparse.near_duplicates_indexed(_document_vectors(spark, sf_dir), 0.95, 1000), "similarity")


def q_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.knn(_vectors(spark, sf_dir), 5), "similarity")


def q_knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.knn(_vectors(spark, sf_dir), 5, block_rows=100, direct_blocks=0), "similarity")


def q_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.find_outliers(_vectors(spark, sf_dir), 50, 5), "outlier_score")


def q_outliers_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.find_outliers(_vectors(spark, sf_dir), 50, 5, block_rows=100, direct_blocks=0), "outlier_score")


def q_project_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = project.project_2d(_vectors(spark, sf_dir))
    return _rounded(placed.select(F.col(ROW_INDEX).alias("row_index"), "x", "y"), "x", "y")


def q_coordinate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = project.project_2d(_vectors(spark, sf_dir))
    return _rounded(project.coordinate_range(placed), "x_min", "x_max", "y_min", "y_max")


def q_component_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of two given components of the vectors."""
    x, y = (F.element_at(VECTOR, i).cast("double") for i in (1, 2))
    return project.coordinate_range(_vectors(spark, sf_dir).withColumns({"x": x, "y": y}))


def q_scatter_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point, with its whole vector as a text of whole millionths."""
    frame = _load_documents(spark, sf_dir).scatter_frame()
    weights = F.transform("embedding", lambda w: F.floor(w.cast("double") * 1_000_000 + 0.5).cast("string"))
    frame = frame.withColumn("embedding", F.array_join(weights, " "))
    return _rounded(frame, "x", "y")


# ---- edits and outputs


def q_mark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = editing.apply_edits(_documents(spark, sf_dir), _edits(spark, sf_dir))
    return marked.select("doc_id", "keep", "flag", "notes")


def q_kept_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.kept(editing.apply_edits(_documents(spark, sf_dir), _edits(spark, sf_dir))).select("doc_id")


def q_mark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _edits(spark, sf_dir)
    counts = editing.curation_counts(editing.apply_edits(_documents(spark, sf_dir), edits))
    return counts.withColumn("updated_rows", F.lit(edits.count()).cast("bigint"))


def q_mark_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = _edits(spark, sf_dir).withColumn(ROW_INDEX, F.col(ROW_INDEX) * 2 - 100)
    bad = editing.out_of_range(shifted, _documents(spark, sf_dir))
    return bad.withColumnRenamed(ROW_INDEX, "row_index")


def _saved(spark: SparkSession, sf_dir: str, save: str, suffix: str) -> DataFrame:
    dataset = _load_documents(spark, sf_dir).apply_edits(_edits(spark, sf_dir))
    target = scratch_path(spark, save) + suffix
    getattr(dataset, save)(target)
    return _read_back(spark, target)


def _read_back(spark: SparkSession, target: str) -> DataFrame:
    """What was saved, with the place of each row in it."""
    source = read_dataset(spark, target)
    return with_row_index(source.rows, source.order_by).withColumnRenamed(ROW_INDEX, "row_index")


def q_save_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir, "save_kept", ".parquet")


def q_save_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir, "save_curated", ".jsonl")


def q_write_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir, "write_template", ".parquet")


def q_apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template comes back with words, and with blanks, in its ``keep`` column."""
    folder = scratch_path(spark, "edited")
    labels = _table(spark, sf_dir, "labels")
    word = F.when(F.col("toxic") == 1, "no").when(F.col("quality") == 1, " YES")
    edited = _documents(spark, sf_dir).drop(ROW_INDEX).join(labels, "doc_id", "left").withColumn("keep", word)
    edited = edited.drop("quality", "toxic").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    write_table(edited, f"{folder}/documents.curated.csv")
    result = finalize(spark, f"{folder}/documents.csv")
    return _read_back(spark, result["path"]).select("row_index", "doc_id", "text", "flag")


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: value for name, value in globals().items() if name.startswith("q_")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:

    def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        return run

    found = _queries()
    if llm_queries:
        found |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return {name: shipped(query) for name, query in found.items()}


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Near-duplicate documents with previews of both rows."""
    ship(spark)
    dataset = _load_documents(spark, sf_dir)
    return dataset.find_near_duplicates(threshold=0.95, top_k=50)


# ---- the same results in SQL

_ROWS = "doc_id, text, lang, source, n_chars"
_PLACE = "row_number() OVER (ORDER BY doc_id) - 1 AS row_index"

# Blanks are removed at both ends as str.strip does it.
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

_HASHED = f"""
  tokens AS (
    SELECT {{id}} AS doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+')) AS token FROM {{table}}
  ),
  counted AS (
    SELECT doc_id, ('0x' || substring(md5(token), 1, 8))::BIGINT % {DIM} AS bucket, count(*)::DOUBLE AS n
    FROM tokens WHERE token <> '' GROUP BY ALL
  ),
  lengths AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM counted GROUP BY doc_id),
  hashed AS (
    SELECT doc_id, bucket, CAST(CAST(n / (len + 1e-12) AS FLOAT) AS DOUBLE) AS weight
    FROM counted JOIN lengths USING (doc_id)
  ),
  unit AS (
    SELECT doc_id, bucket, weight / (sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) + 1e-12) AS u FROM hashed
  )
"""


def _hashed(table: str = "documents", key: str = "doc_id", prefix: str = "") -> str:
    text = _HASHED.format(id=key, table=table).replace("{{", "{").replace("}}", "}")
    for name in ("tokens", "counted", "lengths", "hashed", "unit"):
        text = text.replace(f" {name} ", f" {prefix}{name} ").replace(f"{name}\n", f"{prefix}{name}\n")
    return text


_UNITS = """
  raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  units AS (
    SELECT vec_id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) AS u FROM raw
  ),
  pairs AS (
    SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.u, b.u) AS s FROM units a JOIN units b ON a.vec_id <> b.vec_id
  )
"""

_UNIT_VECTORS = """
  raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  points AS MATERIALIZED (
    SELECT vec_id AS id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) AS u FROM raw
  )
"""


def _axes(table: str) -> str:
    """``placed (id, u, x, y)``: ``points (id, u)`` along the principal axes of ``table``.

    A symmetric matrix that is squared again and again, and kept at trace 1, becomes that of its first axis; the second
    axis is the first of what is left without it.
    """
    square = "list_transform(m, lambda r: list_transform(m, lambda s: list_inner_product(r, s)))"
    trace = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i][i]))"
    scaled = f"list_transform(q, lambda r: list_transform(r, lambda v: v / {trace.format('q')}))"

    def axis(k: int, matrix: str) -> str:
        # Of a matrix of one axis, the row with the largest diagonal entry is that axis with its largest loading positive.
        largest = "list_position(list_transform(range(1, len(m) + 1), lambda i: m[i][i]), list_max(list_transform(range(1, len(m) + 1), lambda i: m[i][i])))"
        return f"""
          power{k}(step, m) AS (
            SELECT 0, m FROM {matrix} UNION ALL
            SELECT step + 1, {scaled} FROM (SELECT step, {square} AS q FROM power{k} WHERE step < 40)
          ),
          axis{k} AS MATERIALIZED (
            SELECT list_transform(r, lambda v: v / sqrt(list_inner_product(r, r))) AS v
            FROM (SELECT m[{largest}] AS r FROM power{k} WHERE step = 40)
          )"""

    return f"""
      entries AS (
        SELECT i, j, avg(u[i] * u[j]) - avg(u[i]) * avg(u[j]) AS c
        FROM {table}, unnest(range(1, (SELECT max(len(u)) FROM {table}) + 1)) AS a(i),
          unnest(range(1, (SELECT max(len(u)) FROM {table}) + 1)) AS b(j) GROUP BY i, j
      ),
      rows_of AS (SELECT i, list(c ORDER BY j) AS r FROM entries GROUP BY i),
      covariance AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM rows_of), {axis(1, "covariance")},
      deflated AS MATERIALIZED (
        SELECT list_transform(m, lambda r, i: list_transform(r, lambda c, j: c - v[i] * v[j] * lambda1)) AS m
        FROM (SELECT m, v, list_inner_product(list_transform(m, lambda r: list_inner_product(r, v)), v) AS lambda1
              FROM covariance, axis1)
      ), {axis(2, "deflated")},
      along AS (
        SELECT p.id, list_inner_product(u, a.v) AS px, list_inner_product(u, b.v) AS py FROM {table} p, axis1 a, axis2 b
      ),
      placed AS MATERIALIZED (
        SELECT p.id, u, list_inner_product(u, a.v) - (SELECT avg(px) FROM along) AS x,
          list_inner_product(u, b.v) - (SELECT avg(py) FROM along) AS y FROM points p, axis1 a, axis2 b
      )"""


_MARKED = """
  marked AS (
    SELECT d.*, NOT (coalesce(toxic, 0) = 1 AND coalesce(quality, 1) = 0) AS keep, coalesce(quality, 1) = 0 AS flag,
      CASE WHEN quality = 0 THEN 'low quality' WHEN toxic = 1 THEN 'toxic' ELSE '' END AS notes
    FROM documents d LEFT JOIN labels USING (doc_id)
  )
"""

_LABELLED = """
  labelled AS (SELECT DISTINCT text FROM documents SEMI JOIN labels USING (doc_id))
"""


def _oracle_sql() -> dict[str, str]:
    key = f"sha256('{MODEL}' || chr(0) || text)"
    lines = f"""
      SELECT doc_id, (part - 1)::INTEGER AS part, {_STRIP.format("line")} AS text
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS part FROM documents)
      WHERE {_STRIP.format("line")} <> ''
    """
    spaced = "replace(text, '.' || chr(10), '.' || chr(10) || chr(10))"
    split = "list_filter(list_transform(string_split({0}, {1}), lambda p: " + _STRIP.format("p") + "), lambda p: p <> '')"
    paragraphs = split.format(spaced, "chr(10) || chr(10)")
    near = f"""
      WITH {_UNITS} SELECT i AS row_a, j AS row_b, round(s, 6) AS similarity FROM pairs
      WHERE i < j AND round(s, 9) >= 0.4 ORDER BY round(s, 9) DESC, i, j LIMIT 1000
    """
    nearest = f"""
      WITH {_UNITS}, ranked AS (
        SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) AS r FROM pairs
      )
    """
    knn = nearest + "SELECT i AS row_index, r::INTEGER AS rank, j AS neighbor, round(s, 6) AS similarity FROM ranked WHERE r <= 5"
    outliers = nearest + """
      , scored AS (SELECT i, 1 - avg(s) AS score FROM ranked WHERE r <= 5 GROUP BY i)
      SELECT i AS row_index, round(score, 6) AS outlier_score FROM scored ORDER BY round(score, 9) DESC, i LIMIT 50
    """
    documents = f"SELECT {_ROWS} FROM documents"
    near_documents = f"""
      WITH {_hashed()}, pairs AS (
        SELECT a.doc_id AS i, b.doc_id AS j, sum(a.u * b.u) AS s
        FROM unit a JOIN unit b ON a.bucket = b.bucket AND a.doc_id < b.doc_id GROUP BY ALL
      )
      SELECT i AS row_a, j AS row_b, round(s, 6) AS similarity FROM pairs
      WHERE round(s, 9) >= 0.95 ORDER BY round(s, 9) DESC, i, j LIMIT 1000
    """
    return {
        "load_documents": f"""
            SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, {_ROWS},
              true AS keep, false AS flag, '' AS notes
            FROM documents WHERE text IS NOT NULL
        """,
        "row_index_sorted": """
            SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index, conv_id, turn FROM conversations
        """,
        "detect_text_column": """
            SELECT 'pages' AS table_name,
              CASE WHEN avg(length(coalesce(html, 'nan'))) > avg(length(coalesce(url, 'nan'))) THEN 'html' ELSE 'url' END
                AS text_column FROM pages
            UNION ALL SELECT 'conversations', 'text' UNION ALL SELECT 'documents', 'source'
        """,
        "csv_round_trip": documents,
        "json_lines_round_trip": documents,
        "json_round_trip": documents,
        "json_with_schema": documents,
        "csv_long_ids": """
            SELECT doc_id, 1234567890123456000 + doc_id AS long_id, (1234567890123456000 + doc_id)::VARCHAR || '789' AS longer
            FROM documents
        """,
        "text_paragraphs": f"""
            SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INTEGER AS part, unnest(parts) AS text FROM (
              SELECT doc_id, CASE WHEN len({paragraphs}) >= 3 THEN {paragraphs}
                ELSE {split.format(spaced, "chr(10)")} END AS parts
              FROM documents)
        """,
        "plaintext_files": f"SELECT unnest({paragraphs}) AS text FROM documents",
        "docx_paragraphs": lines,
        "paged_documents": f"SELECT doc_id, (part + 1)::INTEGER AS page, text FROM ({lines})",
        "row_preview": """
            SELECT doc_id AS row_index, CASE WHEN length(text) <= 240 THEN text ELSE substring(text, 1, 239) || '…' END
              AS text, true AS keep, false AS flag, doc_id FROM documents
        """,
        "row_lookup": f"""
            SELECT doc_id AS row_index, {_ROWS}, true AS keep, false AS flag, '' AS notes
            FROM documents SEMI JOIN labels USING (doc_id)
        """,
        "row_json": """
            SELECT event_id, to_json({
              'event_id': event_id, 'ts': strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'),
              'user_id': CASE WHEN event_type <> 'click' THEN user_id END, 'event_type': event_type,
              'value': CASE WHEN event_type <> 'error' THEN value END, 'props': props
            })::VARCHAR AS json FROM events
        """,
        "coerce_bool": """
            SELECT doc_id, quality <> 0 AS from_int, quality <> 0 AS from_double, toxic = 1 AS from_bool,
              quality = 1 AS from_word, quality = 1 AS from_digit, toxic <> 1 AS from_blank FROM labels
        """,
        "normalize_text": """
            SELECT doc_id, replace(replace(replace(text, '.', '...'), ',', '*'), chr(10), '->(c)(R)' || chr(10)) AS text
            FROM documents
        """,
        "cache_key": f"SELECT doc_id, {key} AS key FROM documents",
        "cache_hits": f"""
            WITH {_LABELLED} SELECT {key} AS key, count(*) AS copies, text IN (SELECT text FROM labelled) AS hit
            FROM documents GROUP BY text
        """,
        "cache_misses": f"""
            WITH {_LABELLED} SELECT DISTINCT {key} AS key, text FROM documents ANTI JOIN labelled USING (text)
        """,
        "cache_stats": f"""
            WITH {_LABELLED} SELECT '{MODEL}' AS model, {DIM} AS dim, count(*) AS rows FROM labelled
        """,
        "cache_upsert": f"WITH {_LABELLED} SELECT {key} AS key, {DIM} AS dim, true AS replaced FROM labelled",
        "hashed_embedding": f"WITH {_hashed()} SELECT doc_id, bucket::INTEGER AS bucket, round(weight, 6) AS weight FROM hashed",
        "embed_one_by_one": f"WITH {_hashed()} SELECT doc_id, bucket::INTEGER AS bucket, round(weight, 6) AS weight FROM hashed",
        "nan_fallback": f"""
            SELECT doc_id, {DIM} AS dim, length(text) < 200 OR NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS is_zero
            FROM documents
        """,
        "nan_reply": f"""
            SELECT doc_id, {DIM} AS dim, length(text) < 200 OR NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS is_zero
            FROM documents
        """,
        "cache_compact": f"""
            WITH {_LABELLED} SELECT {key} AS key, {DIM} AS dim, 'again' AS status, {DIM} AS length FROM labelled
        """,
        "pre_embed": f"""
            WITH {_LABELLED}, hits AS (SELECT count(*) AS n FROM documents SEMI JOIN labelled USING (text))
            SELECT count(*) AS rows, {DIM}::BIGINT AS embedding_dim, count(*) - any_value(n) AS fresh, any_value(n) AS hits
            FROM documents, hits
        """,
        "load_summary": f"""
            WITH {_LABELLED}, hits AS (SELECT count(*) AS n FROM documents SEMI JOIN labelled USING (text))
            SELECT count(*) AS rows, 'text' AS text_column, 'doc_id' AS id_column, '{MODEL}' AS embedding_model,
              {DIM}::BIGINT AS embedding_dim, any_value(n) AS embeddings_cached_hits,
              count(*) - any_value(n) AS embeddings_freshly_computed,
              count(DISTINCT text) - (SELECT count(*) FROM labelled) AS distinct_texts_embedded,
              false AS reduced_to_2d, 'doc_id,text,lang,source,n_chars,keep,flag,notes' AS columns
            FROM documents, hits
        """,
        "status": f"""
            WITH {_MARKED} SELECT count(*) AS rows, {DIM}::BIGINT AS embedding_dim, count(*) FILTER (keep) AS kept_count,
              count(*) FILTER (flag) AS flagged_count, count(*) FILTER (notes <> '') AS noted_count,
              count(DISTINCT text) AS cache_rows, true AS loaded FROM marked
        """,
        "incremental_embed": f"SELECT DISTINCT {key} AS key, {DIM} AS dim, 'ok' AS status FROM documents",
        "incremental_embed_csv": f"SELECT DISTINCT {key} AS key, {DIM} AS dim, 'ok' AS status FROM documents",
        "cosine_similarity": f"""
            WITH {_UNITS} SELECT vec_id, round(list_inner_product(u, (SELECT min_by(u, vec_id) FROM units)), 6)
              AS similarity FROM units
        """,
        "search_topk": f"""
            WITH {_UNITS}, scored AS (
              SELECT vec_id, list_inner_product(u, (SELECT min_by(u, vec_id) FROM units)) AS s FROM units
            )
            SELECT vec_id AS row_index, round(s, 6) AS score FROM scored ORDER BY round(s, 9) DESC, vec_id LIMIT 20
        """,
        "search_text": f"""
            WITH {_hashed()},
            query AS (SELECT 0 AS doc_id, min_by(text, item_id) AS text FROM benchmark),
            {_hashed("query", "doc_id", "q_")},
            scored AS (
              SELECT d.doc_id, coalesce(s, 0) AS s FROM documents d LEFT JOIN (
                SELECT a.doc_id, sum(a.u * b.u) AS s FROM unit a JOIN q_unit b USING (bucket) GROUP BY a.doc_id
              ) m ON m.doc_id = d.doc_id
            )
            SELECT doc_id AS row_index, CASE WHEN length(text) <= 240 THEN text ELSE substring(text, 1, 239) || '…' END
              AS text, true AS keep, false AS flag, doc_id, round(s, 6) AS score
            FROM scored JOIN documents USING (doc_id) ORDER BY round(s, 9) DESC, doc_id LIMIT 20
        """,
        "search_many": f"""
            WITH {_hashed()}, asked AS (SELECT item_id AS doc_id, text FROM benchmark), {_hashed("asked", "doc_id", "q_")},
            sums AS (
              SELECT q.doc_id AS item_id, a.doc_id, sum(a.u * q.u) AS s FROM unit a JOIN q_unit q ON a.bucket = q.bucket GROUP BY ALL
            ),
            ranked AS (
              SELECT item_id AS query_id, doc_id, coalesce(s, 0) AS s,
                row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(s, 0), 9) DESC, doc_id) AS r
              FROM (SELECT item_id, doc_id, d.text FROM benchmark, documents d) LEFT JOIN sums USING (item_id, doc_id)
            )
            SELECT query_id, r::INTEGER AS rank, doc_id AS row_index, CASE WHEN length(text) <= 240 THEN text
              ELSE substring(text, 1, 239) || '…' END AS text, round(s, 6) AS score
            FROM ranked JOIN documents USING (doc_id) WHERE r <= 5
        """,
        "search_many_blocks": f"""
            WITH {_UNITS}, scored AS (
              SELECT a.vec_id AS query_id, b.vec_id AS i, list_inner_product(a.u, b.u) AS s
              FROM units a, units b
            ), ranked AS (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, i) AS r FROM scored
            )
            SELECT query_id, r::INTEGER AS rank, i AS row_index, round(s, 6) AS score FROM ranked WHERE r <= 4
        """,
        "near_duplicates_embeddings": near,
        "near_duplicates_cells": near,
        "near_duplicates_documents": near_documents,
        "near_duplicates_indexed": near_documents,
        "knn": knn,
        "knn_cells": knn,
        "outliers": outliers,
        "outliers_cells": outliers,
        "component_range": """
            SELECT count(*) AS rows, min(embedding[1])::DOUBLE AS x_min, max(embedding[1])::DOUBLE AS x_max,
              min(embedding[2])::DOUBLE AS y_min, max(embedding[2])::DOUBLE AS y_max FROM embeddings
        """,
        "project_2d": f"""
            WITH RECURSIVE {_UNIT_VECTORS}, {_axes("points")}
            SELECT id AS row_index, round(x, 6) AS x, round(y, 6) AS y FROM placed
        """,
        "coordinate_range": f"""
            WITH RECURSIVE {_UNIT_VECTORS}, {_axes("points")}
            SELECT count(*) AS rows, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(min(y), 6) AS y_min,
              round(max(y), 6) AS y_max FROM placed
        """,
        "scatter_frame": f"""
            WITH RECURSIVE {_hashed()}, stored AS MATERIALIZED (
              SELECT d.doc_id AS id, list(coalesce(u, 0)::FLOAT::DOUBLE ORDER BY b) AS e
              FROM documents d JOIN range({DIM}) AS r(b) ON true LEFT JOIN unit ON unit.doc_id = d.doc_id AND bucket = b
              GROUP BY d.doc_id
            ), points AS MATERIALIZED (
              SELECT id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) AS u FROM stored
            ), {_axes("points")}
            SELECT id AS row_index, round(x, 6) AS x, round(y, 6) AS y, source AS color,
              CASE WHEN length(text) <= 240 THEN text ELSE substring(text, 1, 239) || '…' END AS snippet,
              array_to_string(list_transform(e, lambda w: floor(w * 1000000 + 0.5)::BIGINT::VARCHAR), ' ') AS embedding
            FROM placed JOIN stored USING (id) JOIN documents ON doc_id = id
        """,
        "mark_rows": f"WITH {_MARKED} SELECT doc_id, keep, flag, notes FROM marked",
        "kept_filter": f"WITH {_MARKED} SELECT doc_id FROM marked WHERE keep",
        "mark_summary": f"""
            WITH {_MARKED} SELECT count(*) AS rows, count(*) FILTER (keep) AS kept_count,
              count(*) FILTER (flag) AS flagged_count, count(*) FILTER (notes <> '') AS noted_count,
              (SELECT sum(toxic + (1 - quality) + toxic * quality) FROM labels)::BIGINT AS updated_rows FROM marked
        """,
        "mark_out_of_range": """
            SELECT DISTINCT doc_id * 2 - 100 AS row_index FROM labels
            WHERE (toxic = 1 OR quality = 0)
              AND (doc_id * 2 - 100 < 0 OR doc_id * 2 - 100 >= (SELECT count(*) FROM documents))
        """,
        "save_kept": f"WITH {_MARKED} SELECT {_PLACE}, {_ROWS}, flag, notes FROM marked WHERE keep",
        "save_curated": f"WITH {_MARKED} SELECT {_PLACE}, {_ROWS}, keep, flag, notes FROM marked",
        "write_template": f"WITH {_MARKED} SELECT {_PLACE}, {_ROWS}, keep, flag, notes FROM marked",
        "apply_edits": f"""
            SELECT {_PLACE}, doc_id, text, false AS flag FROM documents LEFT JOIN labels USING (doc_id)
            WHERE coalesce(toxic, 0) <> 1
        """,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL giving the same rows. Queries without an entry have no SQL form and are checked by the tests."""
    found = _oracle_sql()
    if llm_queries:
        found |= llm_queries.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
