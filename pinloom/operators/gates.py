"""Gates over evidence: one row for each requirement of a capability and each candidate, their verdict, and who survives."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Capability:
    """What is required of a candidate. Behaviours are (id, version, digest, collector); interfaces and constraints (id, mode)."""

    language: str
    runtime: str
    required_behaviors: tuple[tuple[str, str, str, str], ...] = ()
    prohibited_behaviors: tuple[tuple[str, str, str, str], ...] = ()
    interfaces: tuple[tuple[str, str], ...] = ()
    performance: tuple[tuple[str, str], ...] = ()
    allowed_licenses: tuple[str, ...] = ()
    prohibited_licenses: tuple[str, ...] = ()
    prohibited_dependencies: tuple[str, ...] = ()
    platforms: tuple[str, ...] = ()
    #: Kinds of gates that advise rather than require.
    advisory: tuple[str, ...] = field(default=())


GATE = "gate_id string, gate_kind string, mode string, proof array<string>, absence array<string>, collector string"


def expanded_gates(spark: SparkSession, capability: Capability) -> DataFrame:
    """The gates of a capability, one row for each requirement: the kinds of evidence that prove it and those that disprove it.

    A requirement that asks for nothing becomes a gate named ``.none``. The rows are as few as the requirements.
    """
    c = capability
    rows: list[tuple] = []

    def add(kind: str, suffix: str = "", mode: str | None = None, proof: Sequence[str] = (), absence: Sequence[str] = (), collector: str | None = None) -> None:
        rows.append((f"{kind}.{suffix}" if suffix else kind, kind, mode or ("advisory" if kind in c.advisory else "required"), list(proof), list(absence), collector))

    add("immutable_provenance", proof=["extraction"])
    add("candidate_contract", proof=["contract:valid"], absence=["contract:invalid"])
    add("language", c.language, proof=[f"language:{c.language}"])
    add("runtime", c.runtime, proof=[f"runtime:{c.runtime}"])
    for kind, behaviors in (("required_behavior", c.required_behaviors), ("prohibited_behavior", c.prohibited_behaviors)):
        for name, version, digest, collector in behaviors:
            add(kind, f"{name}@{version}", None, [f"behavior-proof:{name}@{version}:{digest}"], [f"behavior-absence:{name}@{version}:{digest}"], collector)
    if not c.prohibited_behaviors:
        add("prohibited_behavior", "none")
    for name, mode in c.interfaces:
        add("interface_effect", name, mode, [f"interface-proof:{name}"])
    if not c.interfaces:
        add("interface_effect", "none")
    for name, mode in c.performance:
        add("performance", name, mode, [f"performance-proof:{name}:pass"])
    if not c.performance:
        add("performance", "none")
    add("license")
    add("dependency", "policy" if c.prohibited_dependencies else "none", None, ["dependency-closure:complete"], [f"dependency:{x}" for x in c.prohibited_dependencies])
    for name in c.platforms:
        add("platform", name, None, ["platform:any", f"platform:{name}"])
    add("minimum_evidence", proof=["extraction"])
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0]), GATE)


def evaluate_gates(candidates: DataFrame, evidence: DataFrame, gates: DataFrame, capability: Capability) -> DataFrame:
    """(candidate, gate_id, gate_kind, mode, status) for every candidate and gate.

    ``candidates`` has (candidate), ``evidence`` (candidate, kind, collector); rows of kind ``extraction`` are what a candidate was
    extracted from. A status that an assessment asserts (kind ``gate-status/gate_id/status``) comes first. Proof and disproof at
    once are an error; a behaviour's evidence counts only from its collector; of licences all must agree. Evidence is aggregated
    to one row for each candidate and gate before the gates, few as they are, are laid beside the candidates.
    """
    one = candidates.select("candidate").distinct()
    wanted = gates.select("gate_id", F.explode("proof").alias("kind"), F.lit(True).alias("proves"), "collector").unionByName(gates.select("gate_id", F.explode("absence").alias("kind"), F.lit(False).alias("proves"), "collector"))
    fits = F.col("w.collector").isNull() | (F.col("w.collector") == F.col("e.collector"))
    met = evidence.alias("e").join(F.broadcast(wanted.alias("w")), "kind").where(fits).groupBy("e.candidate", "w.gate_id").agg(F.coalesce(F.bool_or("w.proves"), F.lit(False)).alias("proof"), F.coalesce(F.bool_or(~F.col("w.proves")), F.lit(False)).alias("absence"))
    asserted = evidence.where(F.col("kind").startswith("gate-status/")).select("candidate", F.split("kind", "/").alias("_p")).where("size(_p) = 3").groupBy("candidate", F.col("_p")[1].alias("gate_id")).agg(F.count_distinct(F.col("_p")[2]).alias("_k"), F.min(F.col("_p")[2]).alias("_s"))
    marks = asserted.select("candidate", "gate_id", F.when(F.col("_k") == 1, F.col("_s")).otherwise("error").alias("asserted"))
    licences = evidence.where(F.col("kind").startswith("license:")).groupBy("candidate").agg(F.count_distinct("kind").alias("_l"), F.min(F.substring("kind", 9, 1000)).alias("_x"))
    every = one.join(F.broadcast(gates.select("gate_id", "gate_kind", "mode")))
    rows = every.join(met, ["candidate", "gate_id"], "left").join(marks, ["candidate", "gate_id"], "left").join(licences, "candidate", "left")
    proof, absence = F.coalesce("proof", F.lit(False)), F.coalesce("absence", F.lit(False))
    kind = F.col("gate_kind")
    licence = F.when(F.col("_l").isNull(), "unknown").when(F.col("_l") > 1, "error").when(F.col("_x").isin(*capability.prohibited_licenses) | ~F.col("_x").isin(*capability.allowed_licenses), "fail").otherwise("pass")
    status = (
        F.when(F.col("asserted").isNotNull(), F.col("asserted")).when(F.col("gate_id").endswith(".none"), "not_applicable").when(kind == "license", licence)
        .when(kind.isin("required_behavior", "prohibited_behavior") & proof & absence, "error").when(kind == "prohibited_behavior", F.when(proof, "fail").when(absence, "pass").otherwise("unknown"))
        .when(kind.isin("dependency", "candidate_contract") & absence, "fail").when(proof, "pass").otherwise("unknown")
    )
    return rows.select("candidate", "gate_id", "gate_kind", "mode", status.alias("status"))


def verdicts(results: DataFrame) -> DataFrame:
    """(candidate, verdict, complete): reject if a required gate fails, else indeterminate if one is unresolved, else pass."""
    required = F.col("mode") == "required"
    failed = F.coalesce(F.bool_or(required & (F.col("status") == "fail")), F.lit(False))
    open_ = F.coalesce(F.bool_or(required & F.col("status").isin("unknown", "error", "skipped")), F.lit(False))
    return results.groupBy("candidate").agg(F.when(failed, "reject").when(open_, "indeterminate").otherwise("pass").alias("verdict"), (~open_).alias("complete"))


def survivors(candidates: DataFrame, outcome: DataFrame) -> DataFrame:
    """The candidates whose verdict is pass. A candidate supplied twice makes the set invalid: those rows have state ``duplicate``."""
    counts = candidates.groupBy("candidate").agg(F.count("*").alias("_n"))
    return counts.join(outcome.where("verdict = 'pass'").select("candidate"), "candidate", "left_semi").select("candidate", F.when(F.col("_n") > 1, "duplicate").otherwise("survives").alias("state"))


def outcome_parity(baseline: DataFrame, rerun: DataFrame, by: Sequence[str], key: str = "test_id", outcome: str = "outcome") -> DataFrame:
    """Per group whether two vectors of outcomes are equal: (by, tests, missing, added, changed, parity)."""
    a, b = baseline.select(*by, key, F.col(outcome).alias("_a"), F.lit(1).alias("_x")), rerun.select(*by, key, F.col(outcome).alias("_b"), F.lit(1).alias("_y"))
    both = a.join(b, [*by, key], "full_outer")
    counts = both.groupBy(*by).agg(F.count("*").alias("tests"), F.count_if(F.col("_y").isNull()).alias("missing"), F.count_if(F.col("_x").isNull()).alias("added"), F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))
    return counts.withColumn("parity", F.when(F.col("missing") + F.col("added") + F.col("changed") == 0, "exact").otherwise("drift"))


def composition_verdict(candidates: DataFrame, expected: DataFrame, actual: DataFrame, unknown: DataFrame) -> DataFrame:
    """Per candidate: reject if the clashes stated for it (candidate, name) are not exactly those found, or if there are any; else
    indeterminate if something about it is unknown; else accept. The comparison is an except both ways."""
    wrong = expected.exceptAll(actual).unionByName(actual.exceptAll(expected)).select("candidate", F.lit(True).alias("_w")).distinct()
    blocked, open_ = actual.select("candidate", F.lit(True).alias("_b")).distinct(), unknown.select("candidate", F.lit(True).alias("_u")).distinct()
    joined = candidates.select("candidate").distinct().join(wrong, "candidate", "left").join(blocked, "candidate", "left").join(open_, "candidate", "left")
    return joined.select("candidate", F.when(F.col("_w"), "reject_mismatch").when(F.col("_b"), "reject").when(F.col("_u"), "indeterminate").otherwise("accept").alias("verdict"))


def binding_collisions(emitted: DataFrame, recipient: DataFrame, key: str) -> DataFrame:
    """The emitted names that the recipient already holds."""
    return emitted.join(recipient.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def funnel(rows: DataFrame, stages: dict[str, Column], key: Sequence[str]) -> DataFrame:
    """(stage, name, kept): how many rows pass each stage after those before it, and last the distinct keys; one pass."""
    passed, counts = F.lit(True), []
    for name, test in stages.items():
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append((name, passed))
    per = rows.groupBy(*key).agg(*[F.count_if(t).alias(f"_{i}") for i, (_, t) in enumerate(counts)])
    last = len(counts)
    total = per.agg(*[F.coalesce(F.sum(f"_{i}"), F.lit(0)).cast("long").alias(f"s{i}") for i in range(last)], F.count_if(F.col(f"_{last - 1}") > 0).alias(f"s{last}"))
    names = [*stages, "distinct"]
    return total.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("stage"), F.lit(n).alias("name"), F.col(f"s{i}").alias("kept")) for i, n in enumerate(names)])))


def rolled_up(scores: DataFrame, by: Sequence[str], weight: str, score: str) -> DataFrame:
    """The weighted score of a group over its dimensions of eligible weight: (by, weight, score_bps), half up; null where no dimension has a score."""
    known = F.col(score).isNotNull() & (F.col(weight) > 0)
    sums = scores.groupBy(*by).agg(F.coalesce(F.sum(F.when(known, F.col(weight))), F.lit(0)).cast("long").alias("weight"), F.coalesce(F.sum(F.when(known, F.col(weight) * F.col(score))), F.lit(0)).cast("long").alias("_s"))
    return sums.select(*by, "weight", F.when(F.col("weight") > 0, F.expr("(2 * _s + weight) div (2 * weight)")).alias("score_bps"))
