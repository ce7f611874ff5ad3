"""Order, ranks and the measures of ranked results."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinloom.plans.sizing import checkpointed, partitions_for

IDENTITY = ["slug", "commit_sha", "path", "blob_sha", "start_line", "end_line"]


def dedup_matches(matches: DataFrame) -> DataFrame:
    """One row for each identity, of the greatest score and then the greatest list of kinds."""
    best = matches.groupBy(*IDENTITY).agg(F.max(F.struct("score", "matched_kinds")).alias("_b"))
    return best.select(*IDENTITY, "_b.score", "_b.matched_kinds")


def merged_matches(matches: DataFrame) -> DataFrame:
    """One row for each identity, of the greatest score and the union of kinds."""
    return matches.groupBy(*IDENTITY).agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched_kinds")))).alias("matched_kinds"))


def normalized(matches: DataFrame, score: str = "score") -> DataFrame:
    """Min-max normalised scores with 12 decimals, half even; a constant population is 1."""
    bounds = matches.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    low, high = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    exact = lambda c: c.cast("decimal(18,4)")
    value = F.when(high == low, F.lit(1.0)).otherwise(F.bround(exact(F.col(score) - low) / exact(high - low), 12).cast("double"))
    return matches.withColumn("normalized_score", value)


def globally_ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with a rank from 1 over all rows, without bringing them into one task.

    Rows are range-partitioned by the order and written; each partition counts by itself, and the counts of the partitions
    before it, one row each, are added.
    """
    placed = checkpointed(df.repartitionByRange(partitions_for(df), *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_rn") + F.col("_before")).drop("_part", "_rn", "_before")


def ranked_matches(matches: DataFrame) -> DataFrame:
    """Matches in their total order: rank from 1, rank_score = matches - rank + 1. Identities must be unique.

    The matches are written once: their bounds, their number and the sample for the ranges are read from there."""
    matches = checkpointed(matches)
    order = [F.col("score").desc(), *[F.col(c).asc() for c in IDENTITY]]
    out = globally_ranked(normalized(matches), order)
    total = matches.agg(F.count("*").alias("n")).select("n").scalar()
    return out.withColumn("rank_score", (total - F.col("rank") + 1).cast("long"))


def retrieval_metrics(run: DataFrame, judgments: DataFrame, cutoff: int = 10) -> DataFrame:
    """Per task: nDCG, reciprocal rank, success at 1, 5 and 10, recall, and, where judgments are complete, precision and AP.

    ``run`` has (task, item, rank), ``judgments`` (task, item, grade 0 to 2, complete). Gain is the grade; unjudged results
    gain 0 and keep their rank. Useful is grade 1 or more, the exact target grade 2; tasks without one are not scored.
    """
    top = run.where(F.col("rank") <= cutoff).select("task", "item", "rank")
    judged = judgments.select("task", "item", "grade", "complete")
    ideal = judged.withColumn("_i", F.row_number().over(Window.partitionBy("task").orderBy(F.col("grade").desc(), "item")))
    gain = lambda g, r: g / F.log2(r + 1)
    wants = ideal.groupBy("task").agg(
        F.sum(F.when(F.col("_i") <= cutoff, gain(F.col("grade"), F.col("_i")))).alias("ideal"), F.count_if(F.col("grade") >= 1).alias("useful"),
        F.max("grade").alias("best"), F.bool_and("complete").alias("complete"),
    ).where("best = 2")
    graded = top.join(judged.select("task", "item", "grade"), ["task", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    hits = F.count_if(F.col("grade") >= 1).over(Window.partitionBy("task").orderBy("rank"))
    seen = graded.withColumn("_hits", hits).groupBy("task").agg(
        F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.min(F.when(F.col("grade") == 2, F.col("rank"))).alias("exact"),
        F.count_if(F.col("grade") >= 1).alias("found"), F.count_if((F.col("grade") >= 1) & (F.col("rank") <= 5)).alias("found5"),
        F.sum(F.when(F.col("grade") >= 1, F.col("_hits") / F.col("rank"))).alias("precisions"),
    )
    out = wants.join(seen, "task", "left")
    exact, found = F.col("exact"), F.coalesce("found", F.lit(0))
    when = lambda c: F.when(F.col("complete"), c)
    at = lambda k: F.coalesce((exact <= k).cast("double"), F.lit(0.0))
    return out.select(
        "task", (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"), F.coalesce(1.0 / exact, F.lit(0.0)).alias("rr"), at(1).alias("success_1"), at(5).alias("success_5"), at(cutoff).alias("success_10"),
        (found / F.col("useful")).alias("recall"), when(F.coalesce("found5", F.lit(0)) / 5.0).alias("precision_5"), when(found / float(cutoff)).alias("precision_10"),
        when(F.coalesce("precisions", F.lit(0.0)) / F.least(F.col("useful"), F.lit(cutoff))).alias("ap"),
    )


def tie_ranks(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Doubled mid-ranks of samples within their group: ties share the mean of their ranks.

    Equal values are counted first, so that ranks are made over distinct values only.
    """
    counts = samples.groupBy(*by, value).agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("_below", below).withColumn("doubled_rank", 2 * F.col("_below") + F.col("_n") + 1)


def mann_whitney(samples: DataFrame, by: Sequence[str], group: str, first: str, second: str, value: str) -> DataFrame:
    """Two-sided U test of two groups with tie correction and continuity correction: n_first, n_second, u, z, p_value.

    Ranks are aggregated by Spark; the p value of each of the few result rows is computed by a vectorised function, since
    Spark has no erfc. Rows with null values are left out.
    """
    two = samples.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ranks = tie_ranks(two, by, value)
    per = two.groupBy(*by, value).agg(F.count_if(F.col(group) == first).alias("_a"), F.count_if(F.col(group) == second).alias("_b"))
    joined = ranks.join(per, [*by, value])
    n = F.col("_n").cast("decimal(38,0)")
    sums = joined.groupBy(*by).agg(
        F.sum("_a").alias("n_first"), F.sum("_b").alias("n_second"), F.sum(F.col("doubled_rank") * F.col("_a")).alias("_r"), F.sum(n * n * n - n).cast("string").alias("_ties")
    )

    @F.pandas_udf("struct<u double, z double, p_value double>")
    def finish(a, b, r, ties):
        import pandas as pd

        out = []
        for n1, n2, rank_sum, t in zip(a, b, r, ties):
            out.append(u_test(int(n1), int(n2), int(rank_sum), int(t)))
        return pd.DataFrame(out, columns=["u", "z", "p_value"])

    done = sums.withColumn("_t", finish("n_first", "n_second", "_r", "_ties"))
    return done.select(*by, "n_first", "n_second", "_t.u", "_t.z", "_t.p_value")


def u_test(n1: int, n2: int, doubled_rank_sum: int, ties: int) -> tuple[float, float, float]:
    """(u, z, p) from exact counts; no samples on one side, or no variance, give p = 1."""
    total = n1 + n2
    if not n1 or not n2:
        return 0.0, 0.0, 1.0
    doubled = doubled_rank_sum - n1 * (n1 + 1)
    doubled = min(doubled, 2 * n1 * n2 - doubled)
    variance = Fraction(n1 * n2, 12) * (Fraction(total + 1) - Fraction(ties, total * (total - 1)))
    if variance == 0:
        return doubled / 2, 0.0, 1.0
    z = float(max(Fraction(0), abs(Fraction(doubled, 2) - Fraction(n1 * n2, 2)) - Fraction(1, 2))) / math.sqrt(float(variance))
    return doubled / 2, z, min(1.0, math.erfc(z / math.sqrt(2)))


def regression_decision(samples: DataFrame, by: str, group: str, first: str, second: str, value: str, tolerance: float = 1.10, level: float = 0.002, least: int = 6) -> DataFrame:
    """Per ``by``: medians of both groups and the decision. Too few samples are unknown; a median of the second within the tolerance
    passes; beyond it the U test decides: fail below the level, else pass."""
    median = lambda g: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value}) FILTER (WHERE {group} = '{g}')")
    sides = samples.groupBy(by).agg(F.count_if(F.col(group) == first).alias("_a"), F.count_if(F.col(group) == second).alias("_b"), median(first).alias("baseline"), median(second).alias("candidate"))
    tested = mann_whitney(samples, [by], group, first, second, value).select(by, "p_value")
    decision = F.when((F.col("_a") < least) | (F.col("_b") < least), "unknown").when(F.col("candidate") <= tolerance * F.col("baseline"), "pass").when(F.col("p_value") < level, "fail").otherwise("pass")
    return sides.join(tested, by, "left").select(by, "baseline", "candidate", "p_value", decision.alias("decision"))


def nearest_rank(value: str, fraction: float) -> Column:
    """The nearest-rank percentile: the smallest value at or above the fraction."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {value})")
