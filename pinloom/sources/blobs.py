"""Blobs and lines: the tables that searches run over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.functions.digests import git_blob_sha

#: Names that a tree scan skips at any depth: its own records.
SKIPPED = ("pinloom-manifest.json", "index.json")
KEY = ["slug", "commit_sha", "path", "blob_sha"]


def lines_of(content: Column) -> Column:
    r"""The lines of a text as an array: separated by \n only; an empty piece at the end is no line."""
    parts = F.split(content, "\n", -1)
    return F.when(content == "", F.array().cast("array<string>")).when(content.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: The endings that claimed languages give a document, prose as FIXTURES.md has it and source by its language.
ENDINGS = {"en": ".py", "fr": ".rs", "de": ".go", "python": ".py", "rust": ".rs", "go": ".go", "javascript": ".js"}


def document_blobs(documents: DataFrame) -> DataFrame:
    """Documents as blobs of pinned trees; the ending of the path follows the language they claim, in whatever case.

    Other languages, and documents that claim none, end in .txt, for which there is no adapter. Null texts are no blobs.
    """
    ending = F.lit(".txt")
    for language, end in ENDINGS.items():
        ending = F.when(F.lower(F.trim("lang")) == language, end).otherwise(ending)
    text = F.col("text")
    return documents.where(text.isNotNull() & F.col("source").isNotNull()).select(
        F.col("source").alias("slug"), F.sha1(F.col("source").cast("binary")).alias("commit_sha"),
        F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"),
        git_blob_sha(F.encode(text, "UTF-8")).alias("blob_sha"), F.octet_length(text).cast("long").alias("size"), text.alias("content"),
    )


def file_blobs(files: DataFrame) -> DataFrame:
    """Pinned files as blobs; bytes that are no UTF-8 are replaced. Repeated rows are one blob."""
    one = files.groupBy("slug", "commit_sha", "path").agg(F.min("content").alias("_c"))
    return one.select("slug", "commit_sha", "path", git_blob_sha(F.col("_c")).alias("blob_sha"), F.octet_length("_c").cast("long").alias("size"), F.make_valid_utf8(F.col("_c").cast("string")).alias("content"))


def scan_tree(spark: SparkSession, folder: str, slug: str, commit_sha: str) -> DataFrame:
    """The files below a folder as blobs with their bytes, without the scan's own records."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = files.select(F.regexp_replace(F.col("path"), r"^file:/+", "/").alias("_full"), "content", F.col("length").alias("size"))
    path = F.expr(f"substring(_full, {len(folder.rstrip('/')) + 2})")
    out = root.withColumn("path", path).where(~F.element_at(F.split("path", "/"), -1).isin(*SKIPPED))
    return out.select(F.lit(slug).alias("slug"), F.lit(commit_sha).alias("commit_sha"), "path", git_blob_sha(F.col("content")).alias("blob_sha"), "size", "content")


def line_rows(blobs: DataFrame) -> DataFrame:
    """A row for each line, counted from 1."""
    return blobs.select(*KEY, F.posexplode(lines_of(F.col("content"))).alias("_i", "line")).withColumn("line_no", F.col("_i") + 1).drop("_i")
