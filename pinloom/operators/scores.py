"""Scores with honest bounds, gates, and selection by lexicographic comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinloom.functions.scalars import age_score, ratio_bps

#: Weights of the factors of trust.
TRUST_WEIGHTS = {"verification": 20, "parity": 15, "license": 15, "documentation": 10, "tests": 10, "artifact_checksum": 15, "age": 15}


def trust_score(verification: Column, parity: Column, license_confidence: Column, documentation: Column, tests: Column, checksum: Column, released: Column, observed: Column) -> Column:
    """The weighted trust of a manifest, from 0 to 100; an unknown factor counts 50.

    verification: true, sampled, archive-only or false; documentation: how many of its two kinds are there; tests and checksum:
    booleans. Null is unknown.
    """
    unknown = F.lit(50)
    scores = {
        "verification": F.when(verification == "true", 100).when(verification == "sampled", 70).when(verification == "archive-only", 40).when(verification == "false", 0).otherwise(unknown),
        "parity": F.when(parity == "exact", 100).when(parity == "drift", 0).otherwise(unknown),
        "license": F.when(license_confidence == "high", 100).when(license_confidence == "medium", 65).when(license_confidence == "low", 25).otherwise(unknown),
        "documentation": F.when(documentation >= 2, 100).when(documentation == 1, 60).when(documentation == 0, 0).otherwise(unknown),
        "tests": F.when(tests, 100).when(~tests, 0).otherwise(unknown),
        "artifact_checksum": F.when(checksum, 100).when(~checksum, 0).otherwise(unknown),
        "age": age_score(released, observed),
    }
    total = F.lit(50)
    for name, weight in TRUST_WEIGHTS.items():
        total = total + scores[name] * weight
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(total / 100))).cast("int")


def weighted_bounds(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted score of checks (status, score_bps, weight): observed over known ones, exact if all are known, and bounds.

    Known are pass and fail; not_applicable counts nowhere; anything else is unresolved: 0 in the lower, 10000 in the upper bound.
    """
    known = F.col("status").isin("pass", "fail")
    eligible = F.col("status") != "not_applicable"
    sums = checks.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(eligible, F.col("weight"))), F.lit(0)).alias("eligible_weight"), F.coalesce(F.sum(F.when(known, F.col("weight"))), F.lit(0)).alias("included_weight"),
        F.coalesce(F.sum(F.when(known, F.col("weight") * F.col("score_bps"))), F.lit(0)).alias("_k"),
    )
    rounded = lambda n, d: F.when(d > 0, F.floor((F.lit(2) * n + d) / (F.lit(2) * d)).cast("long"))
    e, i, k = F.col("eligible_weight"), F.col("included_weight"), F.col("_k")
    observed = rounded(k, i)
    return sums.select(*by, "eligible_weight", "included_weight", F.when((e > 0) & (i == e), observed).alias("score_bps"), F.when(e > 0, observed).alias("observed_bps"), rounded(k, e).alias("lower_bps"), rounded(k + 10000 * (e - i), e).alias("upper_bps"))


def gate_verdict(checks: DataFrame, by: Sequence[str], required: Column) -> DataFrame:
    """fail if any required check fails, else indeterminate if any is unresolved, else pass; nothing compensates."""
    bad = F.coalesce(F.bool_or(required & (F.col("status") == "fail")), F.lit(False))
    open_ = F.coalesce(F.bool_or(required & ~F.col("status").isin("pass", "fail", "not_applicable")), F.lit(False))
    return checks.groupBy(*by).agg(F.when(bad, "fail").when(open_, "indeterminate").otherwise("pass").alias("verdict"))


def micro_average(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of numerators and denominators and their ratio in basis points; null without a denominator."""
    return metrics.groupBy(*by).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator")).withColumn("score_bps", ratio_bps(F.col("numerator"), F.col("denominator")))


def lexicographic_winners(candidates: DataFrame, key: str, roles: dict[str, Sequence[Column]]) -> DataFrame:
    """For each role the candidate whose values are greatest in the order of its dimensions.

    An unknown value makes a pair incomparable if all dimensions before it are equal; a role with such a pair is unranked.
    Ties go to the least key. Instead of comparing all pairs, candidates are grouped by equal prefixes: a pair is
    incomparable exactly if two candidates agree on a prefix of known values and one of them is unknown in the next.
    """
    out = None
    for role, dimensions in roles.items():
        values = candidates.select(F.col(key).alias("_key"), *[d.alias(f"d{i}") for i, d in enumerate(dimensions)])
        bad = None
        for i in range(len(dimensions)):
            prefix = [f"d{j}" for j in range(i)]
            known = values
            for c in prefix:
                known = known.where(F.col(c).isNotNull())
            groups = known.groupBy(*prefix).agg(F.count("*").alias("n"), F.count_if(F.col(f"d{i}").isNull()).alias("u")).where("n > 1 AND u > 0")
            here = groups.agg(F.count("*").alias("_bad"))
            bad = here if bad is None else bad.unionByName(here)
        blocked = bad.agg(F.sum("_bad").alias("_bad")).select("_bad").scalar()
        sizes = values.groupBy(*[f"d{i}" for i in range(len(dimensions))]).agg(F.min("_key").alias("winner"), F.count("*").alias("n"))
        order = F.struct(*[F.col(f"d{i}") for i in range(len(dimensions))])
        # the greatest value; nulls are least, but only a blocked role or a single candidate can win with one
        best = sizes.agg(F.max_by(F.struct("winner", "n"), order).alias("_b"), F.sum("n").alias("candidates"))
        status = F.when(F.col("candidates").isNull(), "unranked_no_candidates").when(blocked > 0, "unranked_incomparable").when((F.col("_b.n") > 1) | (F.col("candidates") == 1), "equal_identity_tiebreak").otherwise("proved_winner")
        row = best.select(F.lit(role).alias("role"), status.alias("status"), F.when(blocked == 0, F.col("_b.winner")).alias("winner"))
        out = row if out is None else out.unionByName(row)
    return out


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows by an order, by partial sorts."""
    return df.orderBy(*order).limit(k)


def top_k_each(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; partitions reduce to their own first k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def license_route(expressions: Column, prohibited: Sequence[str], study: Sequence[str]) -> Column:
    """Where a source with these licences may go, the most restrictive first: reject, study, reuse; none detected is study."""
    return F.when(F.arrays_overlap(expressions, F.array(*[F.lit(x) for x in prohibited])), "reject").when((F.size(expressions) == 0) | F.arrays_overlap(expressions, F.array(*[F.lit(x) for x in study])), "study").otherwise("reuse")


def license_decision(resolved: DataFrame, by: Sequence[str], order: str, expression: str, state: str, prohibited: Sequence[str], reviewed: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """The decision over all sources of a group: a prohibited one anywhere is incompatible; else the first in order that fails.

    Not resolved or not reviewed is unknown, not allowed is incompatible, else pass.
    """
    e = F.col(expression)
    verdict = F.when(F.coalesce(e.isin(*prohibited), F.lit(False)), "incompatible").when(F.col(state) != "resolved", "unknown").when(~F.coalesce(e.isin(*reviewed), F.lit(False)), "unknown").when(~e.isin(*allowed), "incompatible").otherwise("pass")
    rank = F.when(F.coalesce(e.isin(*prohibited), F.lit(False)), 0).when(verdict != "pass", 1).otherwise(2)
    return resolved.groupBy(*by).agg(F.min_by(verdict, F.struct(rank.alias("r"), F.col(order).alias("o"))).alias("decision"))


#: The tiers of licence evidence, the first that says anything wins.
TIERS = ("file_header", "adjacent_license", "reuse_toml", "dep5")


def tiered_licenses(evidence: DataFrame, by: Sequence[str], tier: str, expression: str) -> DataFrame:
    """(by, expression, state) by tiers: an unknown tier or a null expression anywhere is an error, which comes before all; else the
    first tier decides, resolved with one expression, conflict with several; lower tiers are shadowed."""
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(TIERS, 1))):
        rank = F.when(F.col(tier) == name, i).otherwise(rank)
    per = evidence.select(*by, F.col(expression).alias("_x"), rank.alias("_r")).groupBy(*by, "_r").agg(F.bool_or(F.col("_x").isNull()).alias("_bad"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    whole = per.groupBy(*by).agg(F.bool_or(F.col("_bad") | F.col("_r").isNull()).alias("_bad"), F.min_by(F.struct("_lo", "_hi"), "_r").alias("_t"))
    state = F.when(F.col("_bad"), "error").when(F.col("_t._lo") != F.col("_t._hi"), "conflict").otherwise("resolved")
    return whole.select(*by, F.when(state == "resolved", F.col("_t._lo")).alias("expression"), state.alias("state"))


def agreed(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, agreed, files): the value if all rows of a group have the same, else null."""
    return rows.groupBy(*by).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias("agreed"), F.count("*").alias("files"))


def tool_ratio(documents: DataFrame, key: str, document: str, array: str, numerator: str, denominator: str, least_bps: int) -> DataFrame:
    """(key, numerator, denominator, status) of a tool's JSON reports: sums over an array of records, pass from ``least_bps`` on.

    A report that can't be read, or has nothing to count, is unknown.
    """
    items = F.try_variant_get(F.try_parse_json(F.col(document)), array, "array<variant>")
    total = lambda path: F.aggregate(F.coalesce(items, F.array().cast("array<variant>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.try_variant_get(x, path, "long"), F.lit(0)))
    sums = documents.select(key, total(numerator).alias("numerator"), total(denominator).alias("denominator"))
    status = F.when(F.col("denominator") == 0, "unknown").when(F.col("numerator") * 10000 >= F.col("denominator") * least_bps, "pass").otherwise("fail")
    return sums.withColumn("status", status)
