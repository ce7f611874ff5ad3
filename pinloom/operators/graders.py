"""Graders: numerator and denominator of each metric of each task, exclusions with their reasons, and their sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinloom.functions.scalars import ratio_bps

RECORD = ["task", "metric", "numerator", "denominator", "excluded", "reason"]


def record(metric: str, numerator: Column, denominator: Column, reason: Column | None = None) -> list[Column]:
    """The columns of one metric record; with a reason the record is excluded and counts nothing."""
    reason = F.lit(None).cast("string") if reason is None else reason
    out = reason.isNotNull()
    count = lambda c: F.when(out, 0).otherwise(c).cast("long")
    return [F.lit(metric).alias("metric"), count(numerator).alias("numerator"), count(denominator).alias("denominator"), F.when(out, 1).otherwise(0).alias("excluded"), reason.alias("reason")]


def top_hits(ranking: DataFrame, exact: DataFrame, tasks: DataFrame, cutoffs: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """Records candidate_top1, 3, 10: whether an exact item lies among the first k. ``ranking`` has (task, item, rank), ``exact``
    (task, item), ``tasks`` (task, unranked). Unranked tasks, and those without exact items, are excluded."""
    best = ranking.join(exact.select("task", "item").distinct(), ["task", "item"]).groupBy("task").agg(F.min("rank").alias("_r"))
    has = exact.select("task", F.lit(True).alias("_h")).distinct()
    rows = tasks.select("task", "unranked").join(has, "task", "left").join(best, "task", "left")
    reason = F.when(F.col("_h").isNull(), "no_gold").when(F.col("unranked"), "unranked_no_comparison_evidence")
    parts = [rows.select("task", *record(f"candidate_top{k}", F.coalesce((F.col("_r") <= k).cast("int"), F.lit(0)), F.lit(1), reason)) for k in cutoffs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recall(metric: str, required: DataFrame, observed: DataFrame, tasks: DataFrame) -> DataFrame:
    """Required items (task, item) that were observed, of those required; tasks that require none are excluded."""
    seen = observed.select("task", "item").distinct().withColumn("_o", F.lit(True))
    per = required.select("task", "item").distinct().join(seen, ["task", "item"], "left").groupBy("task").agg(F.count("_o").alias("_n"), F.count("*").alias("_d"))
    return tasks.select("task").join(per, "task", "left").select("task", *record(metric, F.coalesce("_n", F.lit(0)), F.coalesce("_d", F.lit(0)), F.when(F.col("_d").isNull(), "no_gold")))


def missing_rate(metric: str, required: DataFrame, observed: DataFrame, tasks: DataFrame) -> DataFrame:
    """Required items that were not observed, of those required."""
    found = recall(metric, required, observed, tasks)
    return found.withColumn("numerator", F.col("denominator") - F.col("numerator"))


def unjustified_rate(metric: str, observed: DataFrame, justified: DataFrame, tasks: DataFrame) -> DataFrame:
    """Observed items that nothing justifies, of all observed."""
    fine = justified.select("task", "item").distinct().withColumn("_j", F.lit(True))
    per = observed.select("task", "item").distinct().join(fine, ["task", "item"], "left").groupBy("task").agg(F.count_if(F.col("_j").isNull()).alias("_n"), F.count("*").alias("_d"))
    return tasks.select("task").join(per, "task", "left").select("task", *record(metric, F.coalesce("_n", F.lit(0)), F.coalesce("_d", F.lit(0))))


def equal_value(metric: str, tasks: DataFrame, expected: Column, found: Column) -> DataFrame:
    """Whether a task's value is the expected one; tasks without one are excluded."""
    return tasks.select("task", *record(metric, F.coalesce((expected == found).cast("int"), F.lit(0)), F.lit(1), F.when(expected.isNull(), "no_gold")))


def seed_overlap(gold: DataFrame, members: DataFrame, identity: Sequence[str], exact: bool) -> DataFrame:
    """Records of the seed's span. ``gold`` has (task, identity, start_line, end_line), ``members`` the same.

    ``exact``: whether a member is the span. Else the lines that it and the first member of its identity share, of the lines
    from the first to the last of both; without a member 0 of the seed's lines.
    """
    keys = ["task", *identity]
    if exact:
        same = gold.join(members.select(*keys, "start_line", "end_line").distinct(), [*keys, "start_line", "end_line"], "left_semi").select("task", F.lit(1).alias("_s")).distinct()
        return gold.select("task").distinct().join(same, "task", "left").select("task", *record("seed_symbol_exact", F.coalesce("_s", F.lit(0)), F.lit(1)))
    first = members.groupBy(*keys).agg(F.min(F.struct("start_line", "end_line")).alias("_m"))
    both = gold.join(first, keys, "left")
    a, b = F.col("_m.start_line"), F.col("_m.end_line")
    shared = F.greatest(F.lit(0), F.least(F.col("end_line"), b) - F.greatest(F.col("start_line"), a) + 1)
    hull = F.greatest(F.col("end_line"), b) - F.least(F.col("start_line"), a) + 1
    none = F.col("_m").isNull()
    return both.select("task", *record("seed_symbol_line_overlap", F.when(none, 0).otherwise(shared), F.when(none, F.col("end_line") - F.col("start_line") + 1).otherwise(hull)))


def aggregated(records: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Sums per metric (and stratum): numerator, denominator, excluded, score_bps, exclusions by reason in text order."""
    per = records.groupBy(*strata, "metric", "reason").agg(F.sum("numerator").alias("n"), F.sum("denominator").alias("d"), F.sum("excluded").alias("x"))
    reasons = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws("=", "reason", F.col("x").cast("string"))))), ",")
    sums = per.groupBy(*strata, "metric").agg(F.sum("n").cast("long").alias("numerator"), F.sum("d").cast("long").alias("denominator"), F.sum("x").cast("long").alias("excluded"), reasons.alias("exclusions"))
    return sums.withColumn("score_bps", ratio_bps(F.col("numerator"), F.col("denominator")))


def stratified(records: DataFrame, labels: DataFrame) -> DataFrame:
    """The sums by stratum, where a task may stand in several: ``labels`` has (task, strata array)."""
    return aggregated(records.join(labels.select("task", F.explode(F.array_distinct("strata")).alias("stratum")), "task"), ["stratum"])


def ranked_for_benchmark(winners: DataFrame, candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Role winners first, in the order of their roles, then the rest by key, flagged as unranked: (candidate, place, unranked).

    Places of the rest follow the winners, who are as few as the roles; only those are counted in one row.
    """
    roles = {r: i + 1 for i, r in enumerate(order)}
    place = F.create_map(*[x for r, i in roles.items() for x in (F.lit(r), F.lit(i))])
    first = winners.where("winner IS NOT NULL").groupBy(F.col("winner").alias("candidate")).agg(F.min(place[F.col("role")]).alias("place"))
    rest = candidates.select("candidate").distinct().join(first.select("candidate"), "candidate", "left_anti")
    return first.select("candidate", F.col("place").cast("int").alias("place"), F.lit(False).alias("unranked")).unionByName(rest.select("candidate", F.lit(None).cast("int").alias("place"), F.lit(True).alias("unranked")))
