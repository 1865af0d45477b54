"""Document files that need a decoder: one row per paragraph or page."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcurate.functions.text import strip
from textcurate.plans.scratch import materialize
from textcurate.schema import FILE, PART

# Fixed value: the XML namespace of word-processing documents.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_texts(content: bytes) -> list[str]:
    """The paragraphs directly below the body of a .docx file, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        return []
    return [_paragraph_text(p) for p in body.findall(f"{_W}p")]


def _paragraph_text(paragraph: ElementTree.Element) -> str:
    pieces = []
    for child in paragraph:
        # Linked text sits one level deeper; a run's own nodes are the pieces of text.
        runs = child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else [child]
        for node in (n for run in runs if run.tag == f"{_W}r" for n in run):
            if node.tag == f"{_W}t":
                pieces.append(node.text or "")
            elif node.tag in (f"{_W}tab", f"{_W}ptab"):
                pieces.append("\t")
            elif node.tag == f"{_W}noBreakHyphen":
                pieces.append("-")
            elif node.tag == f"{_W}cr" or node.tag == f"{_W}br" and node.get(f"{_W}type", "textWrapping") == "textWrapping":
                pieces.append("\n")  # breaks of pages and columns are no text
    return "".join(pieces)


def extract_parts(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """Run ``extractor`` on the ``content`` of every file row; rows (file, part, text) of its non-blank texts."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One output batch per file, so that no more than one file's texts are held at a time.
            for name, content in zip(batch.column("path"), batch.column("content")):
                texts = extractor(content.as_py())
                yield pa.RecordBatch.from_pydict(
                    {
                        FILE: pa.array([name.as_py()] * len(texts), pa.string()),
                        PART: pa.array(range(len(texts)), pa.int32()),
                        "text": pa.array(texts, pa.string()),
                    }
                )

    parts = files.select("path", "content").mapInArrow(decode, f"{FILE} string, {PART} int, text string")
    return parts.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    # Stored at once: whatever looks at the rows later does not open the files again.
    rows = materialize(extract_parts(spark.read.format("binaryFile").load(path), docx_texts), "parts")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no text")
    return rows


def read_paged(spark: SparkSession, path: str, extractor: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Rows ``page`` (counted from 1) and ``text`` of every page that has text."""
    if extractor is None:
        raise ValueError(f"{path} needs an extractor, which turns a file's bytes into page texts")
    rows = materialize(extract_parts(spark.read.format("binaryFile").load(path), extractor), "parts")
    if rows.isEmpty():
        raise ValueError(f"{path} gave no text; its pages may be images")
    return rows.withColumn("page", F.col(PART) + 1).select(FILE, PART, "page", "text")
