"""Overlapping spans, shared dependencies and clashing versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_union(spans: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """The lines that the spans of a group cover, each counted once: gaps and islands over distinct spans."""
    distinct = spans.where(F.col(end) >= F.col(start)).groupBy(*by, F.col(start).alias("_s")).agg(F.max(end).alias("_e"))
    order = Window.partitionBy(*by).orderBy("_s")
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("_s"), F.coalesce(reach + 1, F.col("_s")))
    return distinct.withColumn("_lines", F.greatest(F.lit(0), F.col("_e") - fresh + 1)).groupBy(*by).agg(F.sum("_lines").cast("long").alias("lines"))


def similar_spans(spans: DataFrame, by: Sequence[str], start: str, end: str, threshold_bps: int = 8000) -> DataFrame:
    """Pairs of distinct spans of a group whose lines overlap by at least the threshold (Jaccard, basis points).

    Columns: the group, a_start, a_end, b_start, b_end, a_copies, b_copies, overlap, union. Equal spans are one, with the
    number of copies. With J as the threshold, two such spans are no longer than 1/J of each other and begin no further
    apart than (1/J - 1) times the shorter; so spans meet only in cells of a grid as wide as their length, exactly.
    """
    if not 5000 <= threshold_bps <= 10000:
        raise ValueError("the grid is exact for thresholds from one half to one")
    one = spans.where(F.col(end) >= F.col(start)).groupBy(*by, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).agg(F.count("*").alias("copies"))
    level = F.floor(F.log2((F.col("e") - F.col("s") + 1).cast("double"))).cast("int")
    here = one.withColumn("level", level)
    # lengths differ by at most a factor 2, so levels by at most 1; starts by less than the longer length
    left = here.withColumn("cell", F.floor(F.col("s") / F.pow(F.lit(2), F.col("level"))).cast("long"))
    near = here.withColumn("lv", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1))).where("lv >= 0")
    center = F.floor(F.col("s") / F.pow(F.lit(2), F.col("lv"))).cast("long")
    right = near.withColumn("cell", F.explode(F.sequence(center - 4, center + 4)))
    a = left.select(*by, F.col("s").alias("a_start"), F.col("e").alias("a_end"), F.col("copies").alias("a_copies"), "level", "cell")
    b = right.select(*by, F.col("s").alias("b_start"), F.col("e").alias("b_end"), F.col("copies").alias("b_copies"), F.col("lv").alias("level"), "cell")
    joined = a.join(b, [*by, "level", "cell"]).where("a_start < b_start OR (a_start = b_start AND a_end < b_end)")
    overlap = F.greatest(F.lit(0), F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1)
    union = (F.col("a_end") - F.col("a_start") + 1) + (F.col("b_end") - F.col("b_start") + 1) - overlap
    out = joined.withColumn("overlap", overlap).withColumn("union", union).where(F.col("overlap") * 10000 >= F.col("union") * threshold_bps)
    return out.select(*by, "a_start", "a_end", "b_start", "b_end", "a_copies", "b_copies", "overlap", "union")


def dependency_overlap(dependencies: DataFrame) -> DataFrame:
    """Dependencies that several pins share: pins of each (ecosystem, name, version), distinct SHAs, and the strength.

    One row for each shared dependency stands for its pairs. resolved_equal: all pins that resolve it agree on the SHA.
    """
    per = dependencies.groupBy("ecosystem", "name", "version", "slug", "commit_sha").agg(F.max("resolved_sha").alias("sha"))
    out = per.groupBy("ecosystem", "name", "version").agg(F.count("*").alias("pins"), F.count("sha").alias("resolved"), F.min("sha").alias("_a"), F.max("sha").alias("_b"))
    strength = F.when((F.col("resolved") > 1) & (F.col("_a") == F.col("_b")), "resolved_equal").when(F.col("resolved") > 1, "resolved_different").otherwise("declared_equal")
    return out.where("pins > 1").select("ecosystem", "name", "version", "pins", "resolved", strength.alias("strength"))


def version_clashes(dependencies: DataFrame) -> DataFrame:
    """Names of which more than one version is declared: (ecosystem, name, versions, pins)."""
    per = dependencies.where("version IS NOT NULL").groupBy("ecosystem", "name", "version").agg(F.count("*").alias("n"))
    clashing = per.groupBy("ecosystem", "name").agg(F.count("*").alias("versions"), F.sum("n").alias("declarations"), F.min("version").alias("lowest"), F.max("version").alias("highest"))
    return clashing.where("versions > 1")


def closure_dedup(dependencies: DataFrame) -> DataFrame:
    """Of each (slug, commit_sha, ecosystem, name, version, spec) one edge, with the greatest SHA."""
    return dependencies.groupBy("slug", "commit_sha", "ecosystem", "name", "version", "spec").agg(F.max("resolved_sha").alias("resolved_sha"))


def namespace_conflicts(names: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """Names that equal one of ``others``, or stand below it or above it in the dotted hierarchy; an equi-join over prefixes."""

    def prefixed(df: DataFrame) -> DataFrame:
        parts = F.split(F.col(name), r"\.")
        prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
        return df.select(F.col(name).alias("full"), F.explode(prefix).alias("prefix")).distinct()

    ours, theirs = names.select(F.col(name).alias("n")).distinct(), others.select(F.col(name).alias("n")).distinct()
    below = prefixed(ours.withColumnRenamed("n", name)).join(theirs.withColumnRenamed("n", "prefix"), "prefix", "left_semi").select(F.col("full").alias(name))
    above = prefixed(theirs.withColumnRenamed("n", name)).select(F.col("prefix").alias(name)).join(ours.withColumnRenamed("n", name), name, "left_semi")
    return below.unionByName(above).distinct()
