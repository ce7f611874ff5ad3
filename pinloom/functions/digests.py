"""Digests of blobs, trees and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def git_blob_sha(content: Column) -> Column:
    """The SHA-1 that git gives a blob, from its bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def tree_digests(files: DataFrame, by: list[str], path: str, sha: str, size: str) -> DataFrame:
    """Per tree: files, bytes, ``tree_sha`` over sorted lines "100644 path NUL blob", and ``h1`` over sorted "digest  path" lines.

    A tree's lines stay in one row, as its digest is a single value of all of them; they hold paths and digests only.
    """
    lines = F.array_sort(F.collect_list(F.concat(F.lit("100644 "), F.col(path), F.lit("\x00"), F.col(sha), F.lit("\n"))))
    digest_lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col("_d").alias("d")))), lambda x: F.concat(x["d"], F.lit("  "), x["p"], F.lit("\n")))
    return files.groupBy(*by).agg(
        F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"), F.sha2(F.array_join(lines, ""), 256).alias("tree_sha"),
        F.concat(F.lit("h1:"), F.base64(F.unhex(F.sha2(F.array_join(digest_lines, ""), 256)))).alias("h1"),
    )


def verified(blobs: DataFrame, content: str = "content", sha: str = "blob_sha") -> DataFrame:
    """The blobs with ``verified``: true if the bytes have the recorded SHA, null where none is recorded."""
    return blobs.withColumn("verified", git_blob_sha(F.col(content)) == F.col(sha))
