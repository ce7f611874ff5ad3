"""Differences of trees and interfaces, verification of file maps, drift of members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer difference of two trees by key: added, removed, modified. Keys must be unique; equal values give no row."""
    a, b = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l")), right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def parity(left: DataFrame, right: DataFrame, by: Sequence[str], path: str, value: str) -> DataFrame:
    """Per group of two trees: compared and differing files, those on one side only, and exact or drift."""
    a, b = left.select(*by, path, F.col(value).alias("_a"), F.lit(1).alias("_l")), right.select(*by, path, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    both = a.join(b, [*by, path], "full_outer")
    common = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    out = both.groupBy(*by).agg(
        F.count_if(common).alias("files_compared"), F.count_if(common & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"),
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
    )
    return out.withColumn("parity", F.when((F.col("differing") == 0) & (F.col("only_left") == 0) & (F.col("only_right") == 0), "exact").otherwise("drift"))


def api_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], signature: str, first_by: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Added, removed and changed names of an interface, with ``payload`` of the first record.

    A name counts as changed only if either side holds exactly one record of it, both have a signature, and these differ.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        row = F.struct(*[F.col(c) for c in first_by], F.col(signature).alias("_sig"), *[F.col(c).alias(f"_p_{c}") for c in payload])
        return df.groupBy(*keys).agg(F.count("*").alias(f"{tag}n"), F.min(row).alias(f"{tag}r"))

    both = side(old, "o").join(side(new, "n"), list(keys), "full_outer")
    single = (F.col("on") == 1) & (F.col("nn") == 1)
    change = F.when(F.col("on").isNull(), "added").when(F.col("nn").isNull(), "removed").when(single & (F.col("or._sig") != F.col("nr._sig")), "changed")
    kept = F.coalesce(F.col("nr"), F.col("or"))
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", *[kept[f"_p_{c}"].alias(c) for c in payload])


def drift(baseline: DataFrame, observed: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """The state of each baseline member: missing, ambiguous (several observed), changed or same."""
    seen = observed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*[F.col(c) for c in compared])).alias("_o"))
    joined = baseline.select(*keys, F.struct(*[F.col(c) for c in compared]).alias("_b")).join(seen, list(keys), "left")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when(F.col("_b").eqNullSafe(F.col("_o")), "same").otherwise("changed")
    return joined.select(*keys, state.alias("state"))


def declared_against_supplied(declared: DataFrame, supplied: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Verifies supplied files against a declared map: verified, mismatch, absent (only declared) or skipped (only supplied)."""
    a, b = declared.select(*keys, F.col(digest).alias("_a"), F.lit(1).alias("_l")), supplied.select(*keys, F.col(digest).alias("_b"), F.lit(1).alias("_r"))
    state = F.when(F.col("_r").isNull(), "absent").when(F.col("_l").isNull(), "skipped").when(F.col("_a") == F.col("_b"), "verified").otherwise("mismatch")
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("state"))


def same_rows(left: DataFrame, right: DataFrame) -> Column | bool:
    """Whether two tables hold the same rows, as bags: except in both directions."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def dedup_hits(hits: DataFrame) -> DataFrame:
    """Hits of an index in three passes: (slug, path, commit_sha, blob_sha) kept, with the size of their content group.

    Hits that pin a path to another blob than the first of that pin are dropped; of each (slug, path) the first by identity
    stays; of each blob the first of those. Firsts are minima, so that no group is gathered.
    """
    identity = F.struct("slug", "commit_sha", "path", "blob_sha")
    pins = hits.groupBy("slug", "commit_sha", "path").agg(F.min("blob_sha").alias("blob_sha"))
    by_path = pins.groupBy("slug", "path").agg(F.min(identity).alias("_h")).select("_h.*")
    return by_path.groupBy("blob_sha").agg(F.min(identity).alias("_h"), F.count("*").alias("group_size")).select("_h.*", "group_size")


def dedup_counts(hits: DataFrame) -> DataFrame:
    """One row: hits, those dropped for disagreeing pins, collapsed ones and survivors."""
    pins = hits.groupBy("slug", "commit_sha", "path").agg(F.min("blob_sha").alias("_first"))
    kept = hits.join(pins, ["slug", "commit_sha", "path"]).agg(F.count("*").alias("hits"), F.count_if(F.col("blob_sha") != F.col("_first")).alias("pin_disagreements"))
    survivors = dedup_hits(hits).agg(F.count("*").alias("survivors"))
    return kept.withColumn("survivors", F.lit(survivors.select("survivors").scalar())).withColumn("collapsed", F.col("hits") - F.col("pin_disagreements") - F.col("survivors"))
