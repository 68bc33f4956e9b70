"""Corpus files: scan, decode, chunk metadata.

scan_corpus   - ``binaryFile`` over a directory tree: regular files whose name
                ends in .md/.txt/.html (case-sensitive), recursively.
decode_files  - UTF-8 with invalid bytes dropped; .html files go through the
                main-text extraction; path made relative to the root; a file
                that cannot be read gets an empty fingerprint (counted failed).
chunk_metadata - the chunk's nested metadata struct.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CORPUS_SUFFIXES
from ..functions.text import utf8_ignore
from ..operators.context import html_main_text

LISTING, LISTING_WAVES = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 3
OPENING, OPENING_BYTES = "spark.sql.files.openCostInBytes", 64 << 10


@contextmanager
def few_tasks(spark: SparkSession):
    """Settings for many small files: a folder of many folders is listed by some tasks a
    core, not one task a folder, and a task reads some hundred files, not four."""
    tasks, cost = spark.conf.get(LISTING), spark.conf.get(OPENING)
    spark.conf.set(LISTING, str(min(int(tasks), LISTING_WAVES * spark.sparkContext.defaultParallelism)))
    spark.conf.set(OPENING, str(OPENING_BYTES))
    try:
        yield
    finally:
        spark.conf.set(LISTING, tasks)
        spark.conf.set(OPENING, cost)


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    glob = "*.{" + ",".join(CORPUS_SUFFIXES) + "}"
    with few_tasks(spark):
        return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                     .option("pathGlobFilter", glob).load(root))


def _relative(path: Column, root: str) -> Column:
    r = root.rstrip("/")
    return F.regexp_replace(path, r"^(file:)?/*" + r.lstrip("/").replace(".", r"\.") + "/", "")


def decode_files(files: DataFrame, root: str) -> DataFrame:
    """(path relative to root, suffix, modificationTime, length, content, text)."""
    suffix = F.regexp_extract("path", r"\.([^./]+)$", 1)
    raw = utf8_ignore(F.col("content"))
    # the page scan is a Python function, which Spark calls for every row: other files' texts stay out of it
    text = F.when(suffix == "html", html_main_text(F.when(suffix == "html", raw))).otherwise(raw)
    return files.select(_relative(F.col("path"), root).alias("path"), suffix.alias("suffix"),
                        "modificationTime", "length", "content", text.alias("text"))


def chunk_metadata(suffix: Column, file_hash: Column) -> Column:
    return F.struct(F.lit("static").alias("source_type"), F.current_timestamp().alias("indexed_at"),
                    F.concat(F.lit("."), suffix).alias("file_type"), file_hash.alias("file_hash"))
