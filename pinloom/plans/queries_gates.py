"""Queries over gates, graders, closures with budgets, and comparisons of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinloom.functions.scalars import package_url
from pinloom.operators import gates as A
from pinloom.operators import graders as H
from pinloom.operators import graph as G
from pinloom.operators import scores as C
from pinloom.plans.queries_analysis import _CHECKS, DEPENDENCIES, _checks, _dependencies
from pinloom.plans.queries_graph import EDGES, edges, seeds
from pinloom.plans.registry import query
from pinloom.sources.tables import table

CAPABILITY = A.Capability(
    "python", "cpython", required_behaviors=(("parse", "1", "d0", "c1"),), prohibited_behaviors=(("net", "1", "d1", "c2"),), interfaces=(("read", "required"), ("log", "advisory")), allowed_licenses=("MIT", "ISC", "Apache-2.0"),
    prohibited_licenses=("GPL-3.0-only",), prohibited_dependencies=("left-pad",), platforms=("linux",),
)
#: Recorded evidence as candidates (x), one for each file, and the kinds of evidence each has.
_EVIDENCE = """
x AS (SELECT slug || '/' || source_path AS candidate, start_line AS n, tier, status, canonical_expression AS e, source_path LIKE '%.py' AS py FROM license_evidence WHERE slug IS NOT NULL AND source_path IS NOT NULL AND start_line IS NOT NULL),
g AS (SELECT candidate, bool_or(py) AS lang, bool_or(n % 2 = 0) AS rt, bool_or(n % 3 = 0) AS bp, bool_or(n % 5 = 0) AS ba, bool_or(n % 7 = 0) AS np, bool_or(n % 2 = 1) AS na, bool_or(n > 3) AS rd, count(DISTINCT e) AS le, min(e) AS lx, bool_or(n % 2 = 1) AS dc, bool_or(n % 13 = 0) AS dp, bool_or(tier = 'dep5') AS pl, bool_or(status = 'selected') AS ok, bool_or(status IS DISTINCT FROM 'selected') AS bad, bool_or(n % 11 = 0) AS sk FROM x GROUP BY candidate),
r AS (SELECT candidate, 'candidate_contract' AS gate_id, 'required' AS mode, CASE WHEN bad THEN 'fail' WHEN ok THEN 'pass' ELSE 'unknown' END AS status FROM g
UNION ALL SELECT candidate, 'dependency.policy', 'required', CASE WHEN dp THEN 'fail' WHEN dc THEN 'pass' ELSE 'unknown' END FROM g UNION ALL SELECT candidate, 'immutable_provenance', 'required', 'pass' FROM g
UNION ALL SELECT candidate, 'interface_effect.log', 'advisory', 'unknown' FROM g UNION ALL SELECT candidate, 'interface_effect.read', 'required', CASE WHEN rd THEN 'pass' ELSE 'unknown' END FROM g
UNION ALL SELECT candidate, 'language.python', 'required', CASE WHEN lang THEN 'pass' ELSE 'unknown' END FROM g
UNION ALL SELECT candidate, 'license', 'required', CASE WHEN le = 0 THEN 'unknown' WHEN le > 1 THEN 'error' WHEN lx = 'GPL-3.0-only' OR lx NOT IN ('MIT', 'ISC', 'Apache-2.0') THEN 'fail' ELSE 'pass' END FROM g
UNION ALL SELECT candidate, 'minimum_evidence', 'required', 'pass' FROM g UNION ALL SELECT candidate, 'performance.none', 'required', 'not_applicable' FROM g
UNION ALL SELECT candidate, 'platform.linux', 'required', CASE WHEN pl THEN 'pass' ELSE 'unknown' END FROM g
UNION ALL SELECT candidate, 'prohibited_behavior.net@1', 'required', CASE WHEN np AND na THEN 'error' WHEN np THEN 'fail' WHEN na THEN 'pass' ELSE 'unknown' END FROM g
UNION ALL SELECT candidate, 'required_behavior.parse@1', 'required', CASE WHEN bp AND ba THEN 'error' WHEN bp THEN 'pass' ELSE 'unknown' END FROM g
UNION ALL SELECT candidate, 'runtime.cpython', 'required', CASE WHEN sk THEN 'skipped' WHEN rt THEN 'pass' ELSE 'unknown' END FROM g)
""".strip()
_VERDICTS = "w AS (SELECT candidate, CASE WHEN bool_or(mode = 'required' AND status = 'fail') THEN 'reject' WHEN bool_or(mode = 'required' AND status IN ('unknown', 'error', 'skipped')) THEN 'indeterminate' ELSE 'pass' END AS verdict, NOT bool_or(mode = 'required' AND status IN ('unknown', 'error', 'skipped')) AS complete FROM r GROUP BY candidate)"


def evidence(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "license_evidence").where("slug IS NOT NULL AND source_path IS NOT NULL AND start_line IS NOT NULL")
    n = F.col("start_line")
    kinds = [
        (F.lit("extraction"), None), (F.when(F.col("source_path").endswith(".py"), "language:python"), None), (F.when(n % 2 == 0, "runtime:cpython"), None), (F.when(n % 3 == 0, "behavior-proof:parse@1:d0"), "c1"),
        (F.when(n % 4 == 0, "behavior-proof:parse@1:d0"), "other"), (F.when(n % 5 == 0, "behavior-absence:parse@1:d0"), "c1"), (F.when(n % 7 == 0, "behavior-proof:net@1:d1"), "c2"), (F.when(n % 2 == 1, "behavior-absence:net@1:d1"), "c2"),
        (F.when(n > 3, "interface-proof:read"), None), (F.concat(F.lit("license:"), F.col("canonical_expression")), None), (F.when(n % 2 == 1, "dependency-closure:complete"), None), (F.when(n % 13 == 0, "dependency:left-pad"), None),
        (F.when(F.col("tier") == "dep5", "platform:any"), None), (F.when(F.coalesce(F.col("status") == "selected", F.lit(False)), "contract:valid").otherwise("contract:invalid"), None), (F.when(n % 11 == 0, "gate-status/runtime.cpython/skipped"), None),
    ]
    rows = F.array(*[F.struct(k.alias("kind"), F.lit(c).cast("string").alias("collector")) for k, c in kinds])
    return t.select(F.concat_ws("/", "slug", "source_path").alias("candidate"), F.inline(rows)).where("kind IS NOT NULL")


def gate_results(spark: SparkSession, d: str) -> DataFrame:
    e = evidence(spark, d)
    return A.evaluate_gates(e.select("candidate"), e, A.expanded_gates(spark, CAPABILITY), CAPABILITY)


@query("gate_expansion", "SELECT * FROM (VALUES ('candidate_contract', 'required'), ('dependency.policy', 'required'), ('immutable_provenance', 'required'), ('interface_effect.log', 'advisory'), ('interface_effect.read', 'required'), ('language.python', 'required'), ('license', 'required'), ('minimum_evidence', 'required'), ('performance.none', 'required'), ('platform.linux', 'required'), ('prohibited_behavior.net@1', 'required'), ('required_behavior.parse@1', 'required'), ('runtime.cpython', 'required')) AS t(gate_id, mode)")
def gate_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The gates of a capability."""
    return A.expanded_gates(spark, CAPABILITY).select("gate_id", "mode")


@query("gate_evaluation", f"WITH {_EVIDENCE} SELECT * FROM r")
def gate_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The status of every gate for every candidate."""
    return gate_results(spark, d).select("candidate", "gate_id", "mode", "status")


@query("candidate_verdicts", f"WITH {_EVIDENCE}, {_VERDICTS} SELECT * FROM w")
def candidate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The verdict of each candidate."""
    return A.verdicts(gate_results(spark, d))


_EASY = A.Capability("python", "cpython", allowed_licenses=("MIT", "ISC", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0"), advisory=("language", "runtime", "dependency", "candidate_contract"))


@query("survivor_set", f"WITH {_EVIDENCE} SELECT candidate, CASE WHEN count(*) > 1 THEN 'duplicate' ELSE 'survives' END AS state FROM x WHERE candidate IN (SELECT candidate FROM g WHERE le = 1 AND lx IN ('MIT', 'ISC', 'Apache-2.0', 'BSD-3-Clause', 'BSD-2-Clause', 'MPL-2.0')) GROUP BY candidate")
def survivor_set(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that pass the gates of an easier capability; those supplied twice are marked."""
    e = evidence(spark, d)
    found = A.verdicts(A.evaluate_gates(e.select("candidate"), e, A.expanded_gates(spark, _EASY), _EASY))
    return A.survivors(e.where("kind = 'extraction'").select("candidate"), found)


_ORDERS = "o AS (SELECT o_custkey AS task, o_orderkey AS item, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, left(o_orderpriority, 1) AS p, o_orderstatus AS s FROM orders), t AS (SELECT task, task % 7 = 0 AS unranked, ['s' || task % 3, 'x' || task % 5] AS strata FROM (SELECT DISTINCT task FROM o))"
_TOP = """b AS (SELECT task, min(rank) FILTER (p = '1') AS r FROM o GROUP BY task), k AS (SELECT unnest([1, 3, 10]) AS k),
q AS (SELECT task, 'candidate_top' || k AS metric, CASE WHEN r IS NULL THEN 'no_gold' WHEN unranked THEN 'unranked_no_comparison_evidence' END AS reason, CAST(coalesce(r <= k, false) AS BIGINT) AS hit FROM t JOIN b USING (task), k),
z AS (SELECT task, metric, CASE WHEN reason IS NULL THEN hit ELSE 0 END AS numerator, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS denominator, CASE WHEN reason IS NULL THEN 0 ELSE 1 END AS excluded, reason FROM q)"""
_SUMS = "CAST(sum(numerator) AS BIGINT) AS numerator, CAST(sum(denominator) AS BIGINT) AS denominator, CAST(sum(excluded) AS BIGINT) AS excluded, CASE WHEN sum(denominator) > 0 THEN CAST((20000 * sum(numerator) + sum(denominator)) // (2 * sum(denominator)) AS BIGINT) END AS score_bps"


def _tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(orders of customers as ranked items, customers as tasks)."""
    o = table(spark, d, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    items = o.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("item"), rank.alias("rank"), F.left("o_orderpriority", F.lit(1)).alias("p"), F.col("o_orderstatus").alias("s"))
    label = lambda head, n: F.concat(F.lit(head), (F.col("task") % n).cast("string"))
    tasks = items.select("task").distinct().select("task", (F.col("task") % 7 == 0).alias("unranked"), F.array(label("s", 3), label("x", 5)).alias("strata"))
    return items, tasks


@query("top_k_hits", f"WITH {_ORDERS}, {_TOP} SELECT * FROM z")
def top_k_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether an urgent order lies among a customer's first 1, 3 and 10."""
    items, tasks = _tasks(spark, d)
    return H.top_hits(items, items.where("p = '1'"), tasks)


@query("stratified_metrics", f"WITH {_ORDERS}, {_TOP} SELECT stratum, metric, {_SUMS} FROM (SELECT z.*, unnest(strata) AS stratum FROM z JOIN t USING (task)) GROUP BY stratum, metric")
def stratified_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The same, summed by strata of which each task has two."""
    items, tasks = _tasks(spark, d)
    return H.stratified(H.top_hits(items, items.where("p = '1'"), tasks), tasks).drop("exclusions")


@query("task_grades", f"""WITH {_ORDERS}, c AS (SELECT task, count(*) FILTER (p = '2') AS need, count(*) FILTER (p = '2' AND s = 'F') AS got, count(*) FILTER (s = 'F') AS seen, count(*) FILTER (s = 'F' AND p <> '2') AS odd, min(p) AS lo, max(p) AS hi FROM o GROUP BY task),
z AS (SELECT 'helper_recall' AS metric, CASE WHEN need > 0 THEN got ELSE 0 END AS numerator, need AS denominator, CASE WHEN need = 0 THEN 1 ELSE 0 END AS excluded FROM c UNION ALL SELECT 'missing_dependency_rate', need - got, need, CASE WHEN need = 0 THEN 1 ELSE 0 END FROM c
UNION ALL SELECT 'hallucinated_dependency_rate', odd, seen, 0 FROM c UNION ALL SELECT 'license_accuracy', CAST(lo = hi AS INTEGER), 1, 0 FROM c WHERE task % 4 <> 0 UNION ALL SELECT 'license_accuracy', 0, 0, 1 FROM c WHERE task % 4 = 0)
SELECT metric, {_SUMS}, CASE WHEN sum(excluded) > 0 THEN 'no_gold=' || CAST(sum(excluded) AS BIGINT) ELSE '' END AS exclusions FROM z GROUP BY metric""")
def task_grades(spark: SparkSession, d: str) -> DataFrame:
    """Recall, missing and unjustified items and equal values over all tasks, with what was excluded."""
    items, tasks = _tasks(spark, d)
    need, seen = items.where("p = '2'"), items.where("s = 'F'")
    ends = items.groupBy("task").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    records = (
        H.recall("helper_recall", need, seen, tasks).unionByName(H.missing_rate("missing_dependency_rate", need, seen, tasks)).unionByName(H.unjustified_rate("hallucinated_dependency_rate", seen, need, tasks))
        .unionByName(H.equal_value("license_accuracy", ends, F.when(F.col("task") % 4 != 0, F.col("lo")), F.col("hi")))
    )
    return H.aggregated(records)


_SEEDS = "gold AS (SELECT l_orderkey AS task, l_partkey % 20 AS symbol, min(l_linenumber) AS a, min(l_linenumber) + 3 AS b FROM lineitem GROUP BY ALL), mem AS (SELECT l_orderkey AS task, l_suppkey % 20 AS symbol, l_linenumber AS a, l_linenumber + CAST(l_quantity AS INTEGER) % 5 AS b FROM lineitem)"


@query("seed_overlap", f"""WITH {_SEEDS}, f AS (SELECT task, symbol, min(struct_pack(a := a, b := b)) AS m FROM mem GROUP BY ALL) SELECT gold.task, 'seed_symbol_line_overlap' AS metric, CAST(CASE WHEN m IS NULL THEN 0 ELSE greatest(0, least(gold.b, m.b) - greatest(gold.a, m.a) + 1) END AS BIGINT) AS numerator, CAST(CASE WHEN m IS NULL THEN gold.b - gold.a + 1 ELSE greatest(gold.b, m.b) - least(gold.a, m.a) + 1 END AS BIGINT) AS denominator FROM gold LEFT JOIN f USING (task, symbol)
UNION ALL SELECT task, 'seed_symbol_exact', CAST(bool_or(EXISTS (SELECT 1 FROM mem WHERE mem.task = gold.task AND mem.symbol = gold.symbol AND mem.a = gold.a AND mem.b = gold.b)) AS BIGINT), 1 FROM gold GROUP BY task""")
def seed_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How far the span of a seed and the first member of its symbol share lines, and whether any member is the span."""
    t = table(spark, d, "lineitem")
    gold = t.groupBy(F.col("l_orderkey").alias("task"), (F.col("l_partkey") % 20).alias("symbol")).agg(F.min("l_linenumber").alias("start_line")).withColumn("end_line", F.col("start_line") + 3)
    members = t.select(F.col("l_orderkey").alias("task"), (F.col("l_suppkey") % 20).alias("symbol"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5).alias("end_line"))
    both = H.seed_overlap(gold, members, ["symbol"], False).unionByName(H.seed_overlap(gold, members, ["symbol"], True))
    return both.select("task", "metric", "numerator", "denominator")


@query("benchmark_ranking", "SELECT p_partkey AS candidate, CAST(CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)) THEN 1 END AS INTEGER) AS place, p_partkey <> (SELECT min(p_partkey) FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)) AS unranked FROM part")
def benchmark_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The winner of the price role first, the other parts unranked."""
    p = table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("b"))
    winners = C.lexicographic_winners(p, "p_partkey", {"price": [F.col("b")]})
    return H.ranked_for_benchmark(winners, p.select(F.col("p_partkey").alias("candidate")), ["price"])


@query("outcome_parity", "WITH a AS (SELECT o_custkey AS g, o_orderkey AS t, o_orderstatus AS x FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_custkey AS g, o_orderkey AS t, CASE WHEN o_orderkey % 11 = 0 THEN 'P' ELSE o_orderstatus END AS y FROM orders WHERE o_orderkey % 7 <> 0), j AS (SELECT coalesce(a.g, b.g) AS g, a.t AS t1, b.t AS t2, x, y FROM a FULL JOIN b ON a.g = b.g AND a.t = b.t), c AS (SELECT g, count(*) AS tests, count(*) FILTER (t2 IS NULL) AS missing, count(*) FILTER (t1 IS NULL) AS added, count(*) FILTER (t1 IS NOT NULL AND t2 IS NOT NULL AND x IS DISTINCT FROM y) AS changed FROM j GROUP BY g) SELECT *, CASE WHEN missing + added + changed = 0 THEN 'exact' ELSE 'drift' END AS parity FROM c")
def outcome_parity(spark: SparkSession, d: str) -> DataFrame:
    """Whether two runs of a customer's tests had the same outcomes."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("test_id"), F.col("o_orderstatus").alias("outcome"))
    rerun = o.where("test_id % 7 <> 0").withColumn("outcome", F.when(F.col("test_id") % 11 == 0, "P").otherwise(F.col("outcome")))
    return A.outcome_parity(o.where("test_id % 5 <> 0"), rerun, ["g"])


@query("composition_verdicts", f"""WITH {DEPENDENCIES}, a AS (SELECT slug AS candidate, name FROM deps GROUP BY slug, name HAVING count(DISTINCT version) > 1), e AS (SELECT * FROM a WHERE candidate <> 'o7'), u AS (SELECT DISTINCT slug AS candidate FROM deps WHERE resolved_sha IS NULL AND right(slug, 1) = '3'), k AS (SELECT DISTINCT slug AS candidate FROM deps),
w AS (SELECT DISTINCT candidate FROM ((SELECT * FROM e EXCEPT ALL SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT ALL SELECT * FROM e))) SELECT candidate, CASE WHEN candidate IN (SELECT candidate FROM w) THEN 'reject_mismatch' WHEN candidate IN (SELECT candidate FROM a) THEN 'reject' WHEN candidate IN (SELECT candidate FROM u) THEN 'indeterminate' ELSE 'accept' END AS verdict FROM k""")
def composition_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether candidates' dependencies compose; one of them states other clashes than it has."""
    deps = _dependencies(spark, d)
    actual = deps.groupBy(F.col("slug").alias("candidate"), "name").agg(F.count_distinct("version").alias("n")).where("n > 1").select("candidate", "name")
    unknown = deps.where("resolved_sha IS NULL").select(F.col("slug").alias("candidate")).where(F.col("candidate").endswith("3"))
    return A.composition_verdict(deps.select(F.col("slug").alias("candidate")), actual.where("candidate <> 'o7'"), actual, unknown)


@query("binding_collisions", "SELECT DISTINCT slug, qualified_name, name FROM symbol_snapshots WHERE snapshot_no = 6 AND kind = 'class' AND name IN (SELECT name FROM symbol_snapshots WHERE snapshot_no = 1 AND kind <> 'class' AND name IS NOT NULL)")
def binding_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Classes whose name something else held in the first snapshot."""
    s = table(spark, d, "symbol_snapshots")
    return A.binding_collisions(s.where("snapshot_no = 6 AND kind = 'class'").select("slug", "qualified_name", "name").distinct(), s.where("snapshot_no = 1 AND kind <> 'class'"), "name")


@query("dimension_rollup", f"WITH {_CHECKS}, s AS (SELECT g, sum(weight) FILTER (status IN ('pass', 'fail')) AS w, CASE WHEN sum(weight) FILTER (status IN ('pass', 'fail')) > 0 THEN CAST((2 * sum(weight * score_bps) FILTER (status IN ('pass', 'fail')) + sum(weight) FILTER (status IN ('pass', 'fail'))) // (2 * sum(weight) FILTER (status IN ('pass', 'fail'))) AS BIGINT) END AS b FROM c GROUP BY g), t AS (SELECT g % 4 AS area, coalesce(sum(w) FILTER (b IS NOT NULL AND w > 0), 0) AS weight, sum(w * b) FILTER (b IS NOT NULL AND w > 0) AS k FROM s GROUP BY 1) SELECT area, CAST(weight AS BIGINT) AS weight, CASE WHEN weight > 0 THEN CAST((2 * k + weight) // (2 * weight) AS BIGINT) END AS score_bps FROM t")
def dimension_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Scores of groups of checks, rolled up once more by area."""
    known = C.weighted_bounds(_checks(spark, d), ["g"]).select((F.col("g") % 4).alias("area"), F.col("included_weight").alias("weight"), F.col("observed_bps").alias("score"))
    return A.rolled_up(known, ["area"], "weight", "score")


@query("assessment", """WITH p AS (SELECT c_custkey AS check_id, c_custkey % 20 AS area, 1 + c_custkey % 3 AS weight FROM customer), r AS (SELECT o_custkey AS check_id, max(CAST(floor(o_totalprice) AS BIGINT) % 10001) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT area, count(*) AS checks, count(*) FILTER (score IS NULL) AS unknown, CAST(sum(weight) AS BIGINT) AS weight, CAST((2 * coalesce(sum(weight * score), 0) + sum(weight)) // (2 * sum(weight)) AS BIGINT) AS lower_bps, CAST((2 * sum(weight * coalesce(score, 10000)) + sum(weight)) // (2 * sum(weight)) AS BIGINT) AS upper_bps FROM p LEFT JOIN r USING (check_id) GROUP BY area""")
def assessment(spark: SparkSession, d: str) -> DataFrame:
    """A policy's checks joined with results; checks without one are unknown and widen the bounds."""
    policy = table(spark, d, "customer").select(F.col("c_custkey").alias("check_id"), (F.col("c_custkey") % 20).alias("area"), (1 + F.col("c_custkey") % 3).alias("weight"))
    results = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("check_id")).agg(F.max(F.floor("o_totalprice").cast("long") % 10001).alias("score_bps"))
    joined = policy.join(results, "check_id", "left").withColumn("status", F.when(F.col("score_bps").isNull(), "unknown").otherwise("pass"))
    counts = joined.groupBy("area").agg(F.count("*").alias("checks"), F.count_if(F.col("score_bps").isNull()).alias("unknown"))
    return C.weighted_bounds(joined, ["area"]).join(counts, "area").select("area", "checks", "unknown", F.col("eligible_weight").alias("weight"), "lower_bps", "upper_bps")


_RULES = "u AS (SELECT DISTINCT src, dst FROM edges), e AS (SELECT src, dst, CASE left(dst, 1) WHEN 'o' THEN 'donor' WHEN 'p' THEN 'stdlib' WHEN 's' THEN 'stdlib' ELSE 'external' END AS o FROM u), rules AS (SELECT 's' || s_suppkey AS node, 'reject' AS d FROM supplier WHERE s_suppkey % 2 = 0), pure AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size % 2 = 0), k AS (SELECT src, dst, CASE WHEN d IS NOT NULL THEN d WHEN o = 'donor' THEN 'include' WHEN o = 'stdlib' AND dst IN (SELECT node FROM pure) THEN 'external' ELSE 'reject' END AS disposition, CASE WHEN d IS NOT NULL THEN 'rule' WHEN o = 'donor' THEN 'origin' WHEN o = 'stdlib' AND dst IN (SELECT node FROM pure) THEN 'allowlist' ELSE 'none' END AS decided_by FROM e LEFT JOIN rules ON node = dst)"


def _classified(spark: SparkSession, d: str) -> DataFrame:
    letter = F.left("dst", F.lit(1))
    origin = F.when(letter == "o", "donor").when(letter.isin("p", "s"), "stdlib").otherwise("external")
    rules = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.lit("reject").alias("disposition"))
    pure = table(spark, d, "part").where("p_size % 2 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return G.classified_edges(edges(spark, d).select("src", "dst").distinct().withColumn("dst_origin", origin), rules, pure)


@query("rule_precedence", f"WITH {EDGES}, {_RULES} SELECT disposition, decided_by, count(*) AS n FROM k GROUP BY ALL")
def rule_precedence(spark: SparkSession, d: str) -> DataFrame:
    """How many edges each level of the rules decides."""
    return _classified(spark, d).groupBy("disposition", "decided_by").agg(F.count("*").alias("n"))


@query("budgeted_closure", f"""WITH {EDGES}, {_RULES}, s AS (SELECT 'c' || c_custkey AS node, 0 AS depth FROM customer WHERE c_acctbal > 9950), w AS (SELECT node, depth FROM s UNION SELECT k.dst, 1 FROM k JOIN s ON k.src = s.node WHERE disposition = 'include'), p AS (SELECT node, CAST(depth AS INTEGER) AS depth, row_number() OVER (ORDER BY depth, node) AS position FROM w)
SELECT node, depth, position, CASE WHEN position > 40 THEN 'frontier' ELSE 'member' END AS state FROM p""")
def budgeted_closure(spark: SparkSession, d: str) -> DataFrame:
    """The closure of rich customers within a budget of forty nodes."""
    found = _classified(spark, d)
    nodes = found.select(F.col("src").alias("node")).unionByName(found.select(F.col("dst").alias("node"))).unionByName(seeds(spark, d, "c_acctbal > 9950")).distinct()
    none = found.select(F.col("src").alias("node")).limit(0)
    return G.budgeted_closure(found, nodes, seeds(spark, d, "c_acctbal > 9950"), none, 8, 40, 1_000_000)[0]


@query("import_support", "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS edge, CASE WHEN l_linenumber % 4 > 0 THEN l_partkey END AS binding FROM lineitem), i AS (SELECT s_suppkey AS imp, s_suppkey * 3 AS binding, CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey * 5 END AS site FROM supplier) SELECT DISTINCT edge, imp AS \"import\" FROM r JOIN i ON r.binding = i.binding OR r.binding = i.site")
def import_support(spark: SparkSession, d: str) -> DataFrame:
    """The imports that support runtime edges, by binding or by site."""
    runtime = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_partkey")).alias("binding"))
    imports = table(spark, d, "supplier").select(F.col("s_suppkey").alias("import"), (F.col("s_suppkey") * 3).alias("binding"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_suppkey") * 5).alias("site"))
    return G.import_support(runtime, imports)


_NODES = "n AS (SELECT DISTINCT 'donor' AS origin, kind, coalesce(module, '') AS module, qualified_name FROM symbol_snapshots WHERE snapshot_no = 6 AND qualified_name IS NOT NULL)"


@query("symbol_nodes", f"WITH {_NODES} SELECT * FROM n")
def symbol_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of a graph made of symbols."""
    return G.nodes_of_symbols(table(spark, d, "symbol_snapshots").where("snapshot_no = 6"))


@query("seed_nodes", f"WITH {_NODES} SELECT qualified_name, CASE WHEN count(*) = 1 THEN min(module || ':' || kind) END AS node, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM n WHERE kind IN ('function', 'class') GROUP BY qualified_name")
def seed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The symbols a closure may start at."""
    nodes = G.nodes_of_symbols(table(spark, d, "symbol_snapshots").where("snapshot_no = 6")).withColumn("node", F.concat_ws(":", "module", "kind"))
    return G.seed_nodes(nodes, ["function", "class"])


@query("async_states", f"WITH {EDGES}, p AS (SELECT a.src AS root, a.dst AS node FROM edges a WHERE a.src LIKE 's%' UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src LIKE 's%') SELECT root, CASE WHEN bool_or(node = 'r0') THEN 'incompatible' WHEN bool_or(node IN ('n1', 'n2', 'n3', 'r3')) THEN 'unknown' ELSE 'compatible' END AS state FROM p GROUP BY root")
def async_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether suppliers reach a blocking region, or one that isn't known."""
    roots = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    named = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    return G.async_assessment(G.shortest_paths(edges(spark, d), roots, 8), named("r0"), named("n1", "n2", "n3", "r3"))


@query("concurrency_classes", "SELECT slug, CASE WHEN bool_or(signature LIKE 'async %') AND bool_or(signature NOT LIKE 'async %') THEN 'mixed' WHEN bool_or(signature LIKE 'async %') THEN 'async' WHEN bool_or(signature NOT LIKE 'async %') THEN 'sync' ELSE 'unknown' END AS class FROM symbol_snapshots WHERE snapshot_no = 6 GROUP BY slug")
def concurrency_classes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a repository's functions are async, sync or both."""
    is_async = F.col("signature").startswith("async ")
    has, lacks = F.coalesce(F.bool_or(is_async), F.lit(False)), F.coalesce(F.bool_or(~is_async), F.lit(False))
    return table(spark, d, "symbol_snapshots").where("snapshot_no = 6").groupBy("slug").agg(F.when(has & lacks, "mixed").when(has, "async").when(lacks, "sync").otherwise("unknown").alias("class"))


@query("cost_counts", "WITH f AS (SELECT DISTINCT file_id, slug, regexp_extract(path, '[.][a-z]+$') AS ending, content FROM verified_bytes WHERE content IS NOT NULL AND path IS NOT NULL) SELECT slug, ending, count(*) AS files, CAST(sum(octet_length(content)) AS BIGINT) AS bytes, CAST(sum((octet_length(content) - len(regexp_extract_all(hex(content), '(?:[0-9A-F]{2})')) + len(list_filter(regexp_extract_all(hex(content), '(?:[0-9A-F]{2})'), lambda h: h = '0A'))) + CASE WHEN octet_length(content) > 0 AND right(hex(content), 2) <> '0A' THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM f GROUP BY slug, ending")
def cost_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files, bytes and physical lines by ending."""
    f = table(spark, d, "verified_bytes").where("content IS NOT NULL AND path IS NOT NULL").select("file_id", "slug", F.regexp_extract("path", "[.][a-z]+$", 0).alias("ending"), "content").distinct()
    text = F.expr("decode(content, 'ISO-8859-1')")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)
    return f.groupBy("slug", "ending").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).cast("long").alias("bytes"), F.sum(lines).cast("long").alias("lines"))


@query("known_costs", "SELECT l_orderkey, CASE WHEN count(*) = count(CASE WHEN l_linenumber <> 3 THEN l_quantity END) THEN CAST(sum(l_quantity) AS BIGINT) END AS cost FROM lineitem GROUP BY l_orderkey")
def known_costs(spark: SparkSession, d: str) -> DataFrame:
    """A cost only where every part of it is known: third lines have none."""
    part = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.count("*") == F.count(part), F.sum("l_quantity").cast("long")).alias("cost"))


@query("retrieval_provenance", "SELECT slug, commit_sha, source_path, list_sort(list_distinct(list(tier))) AS tiers, count(*) AS n FROM (SELECT DISTINCT slug, commit_sha, source_path, tier, evidence_path, start_line FROM license_evidence WHERE tier IS NOT NULL) GROUP BY slug, commit_sha, source_path")
def retrieval_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Where the evidence about each file came from."""
    t = table(spark, d, "license_evidence").where("tier IS NOT NULL").select("slug", "commit_sha", "source_path", "tier", "evidence_path", "start_line").distinct()
    return t.groupBy("slug", "commit_sha", "source_path").agg(F.array_sort(F.collect_set("tier")).alias("tiers"), F.count("*").alias("n"))


@query("license_tiers", """WITH e AS (SELECT DISTINCT slug, commit_sha, source_path, tier, canonical_expression AS x, CASE tier WHEN 'file_header' THEN 1 WHEN 'adjacent_license' THEN 2 WHEN 'reuse_toml' THEN 3 WHEN 'dep5' THEN 4 END AS r FROM license_evidence WHERE source_path IS NOT NULL), b AS (SELECT slug, commit_sha, source_path, bool_or(x IS NULL OR r IS NULL) AS bad, min(r) AS r FROM e GROUP BY ALL),
s AS (SELECT b.slug, b.commit_sha, b.source_path, b.bad, count(DISTINCT e.x) AS k, min(e.x) AS x FROM b JOIN e ON e.slug IS NOT DISTINCT FROM b.slug AND e.commit_sha IS NOT DISTINCT FROM b.commit_sha AND e.source_path = b.source_path AND (e.r = b.r OR b.bad) GROUP BY ALL)
SELECT slug, commit_sha, source_path, CASE WHEN NOT bad AND k = 1 THEN x END AS expression, CASE WHEN bad THEN 'error' WHEN k > 1 THEN 'conflict' ELSE 'resolved' END AS state FROM s""")
def license_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The licence of each file by the first tier that says anything; an error in any tier rejects before."""
    tiers = table(spark, d, "license_evidence").where("source_path IS NOT NULL").select("slug", "commit_sha", "source_path", "tier", "canonical_expression").distinct()
    return C.tiered_licenses(tiers, ["slug", "commit_sha", "source_path"], "tier", "canonical_expression")


@query("root_licenses", "WITH e AS (SELECT slug, commit_sha, path, upper(regexp_extract(path, '[^.]*$')) AS id FROM (SELECT DISTINCT slug, commit_sha, path FROM verified_bytes WHERE path IS NOT NULL AND NOT contains(path, '/'))) SELECT slug, commit_sha, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS agreed, count(*) AS files FROM e GROUP BY slug, commit_sha")
def root_licenses(spark: SparkSession, d: str) -> DataFrame:
    """What all files at the top of a pin agree on: here their ending, as a licence's id would be."""
    e = table(spark, d, "verified_bytes").where("path IS NOT NULL AND NOT contains(path, '/')").select("slug", "commit_sha", "path").distinct().withColumn("id", F.upper(F.regexp_extract("path", "[^.]*$", 0)))
    return C.agreed(e, ["slug", "commit_sha"], "id")


@query("test_directories", "SELECT slug, bool_or(starts_with(path, 'tests/') OR starts_with(path, 'test/')) AS has_tests FROM verified_bytes WHERE path IS NOT NULL GROUP BY slug")
def test_directories(spark: SparkSession, d: str) -> DataFrame:
    """Whether a repository has a directory of tests at its top."""
    return table(spark, d, "verified_bytes").where("path IS NOT NULL").groupBy("slug").agg(F.bool_or(F.col("path").rlike("^tests?/")).alias("has_tests"))


@query("bill_membership", "WITH s AS (SELECT DISTINCT lower(ecosystem) AS ecosystem, lower(name) AS name FROM declared_dependencies WHERE graph_kind = 'complete' AND name IS NOT NULL) SELECT DISTINCT slug, lower(ecosystem) AS ecosystem, lower(name) AS name, version FROM declared_dependencies d WHERE EXISTS (SELECT 1 FROM s WHERE s.ecosystem = lower(d.ecosystem) AND s.name = lower(d.name))")
def bill_membership(spark: SparkSession, d: str) -> DataFrame:
    """The declared packages that some complete closure holds."""
    t = table(spark, d, "declared_dependencies").select("slug", F.lower("ecosystem").alias("ecosystem"), F.lower("name").alias("name"), "version", "graph_kind").where("name IS NOT NULL")
    return t.join(t.where("graph_kind = 'complete'").select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_semi").select("slug", "ecosystem", "name", "version").distinct()


@query("cyclonedx_components", "SELECT DISTINCT slug, commit_sha, '{\"bom-ref\":\"pkg:' || lower(ecosystem) || '/' || lower(name) || '@' || version || '\",\"name\":\"' || lower(name) || '\",\"type\":\"library\",\"version\":\"' || version || '\"}' AS component FROM declared_dependencies WHERE name IS NOT NULL AND version IS NOT NULL AND ecosystem IS NOT NULL")
def cyclonedx_components(spark: SparkSession, d: str) -> DataFrame:
    """The components of each pin's bill, as CycloneDX writes them, one row each: a document is their rows behind a head."""
    t = table(spark, d, "declared_dependencies").where("name IS NOT NULL AND version IS NOT NULL AND ecosystem IS NOT NULL")
    name = F.lower("name")
    part = F.struct(package_url(F.col("ecosystem"), name, F.col("version")).alias("bom-ref"), name.alias("name"), F.lit("library").alias("type"), F.col("version"))
    return t.select("slug", "commit_sha", F.to_json(part).alias("component")).distinct()


@query("spdx_relationships", "WITH t AS (SELECT DISTINCT slug, commit_sha, lower(name) AS name, version FROM declared_dependencies WHERE name IS NOT NULL AND version IS NOT NULL) SELECT slug, commit_sha, '{\"relatedSpdxElement\":\"SPDXRef-' || regexp_replace(name || '-' || version, '[^A-Za-z0-9.-]', '-', 'g') || '\",\"relationshipType\":\"DEPENDS_ON\",\"spdxElementId\":\"SPDXRef-DOCUMENT\"}' AS relationship FROM t")
def spdx_relationships(spark: SparkSession, d: str) -> DataFrame:
    """The relationships of each pin's SPDX document, one row each."""
    t = table(spark, d, "declared_dependencies").where("name IS NOT NULL AND version IS NOT NULL").select("slug", "commit_sha", F.lower("name").alias("name"), "version").distinct()
    ref = F.concat(F.lit("SPDXRef-"), F.regexp_replace(F.concat_ws("-", "name", "version"), "[^A-Za-z0-9.-]", "-"))
    return t.select("slug", "commit_sha", F.to_json(F.struct(ref.alias("relatedSpdxElement"), F.lit("DEPENDS_ON").alias("relationshipType"), F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"))).alias("relationship"))


@query("fetch_benchmark", "WITH e AS (SELECT DISTINCT slug, commit_sha, source_path, start_line FROM license_evidence WHERE source_path IS NOT NULL), f AS (SELECT DISTINCT slug, commit_sha, path FROM verified_bytes), s AS (SELECT DISTINCT slug FROM f) SELECT e.*, CASE WHEN f.path IS NOT NULL THEN 'present' WHEN s.slug IS NULL THEN 'no_repository' ELSE 'no_file' END AS state FROM e LEFT JOIN f ON f.slug = e.slug AND f.commit_sha = e.commit_sha AND f.path = e.source_path LEFT JOIN s ON s.slug = e.slug")
def fetch_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Whether the files that recorded evidence speaks of were fetched."""
    e = table(spark, d, "license_evidence").where("source_path IS NOT NULL").select("slug", "commit_sha", "source_path", "start_line").distinct()
    f = table(spark, d, "verified_bytes").select("slug", "commit_sha", F.col("path").alias("source_path")).distinct().withColumn("_f", F.lit(True))
    s = f.select("slug").distinct().withColumn("_s", F.lit(True))
    state = F.when(F.col("_f"), "present").when(F.col("_s").isNull(), "no_repository").otherwise("no_file")
    return e.join(f, ["slug", "commit_sha", "source_path"], "left").join(s, "slug", "left").select("slug", "commit_sha", "source_path", "start_line", state.alias("state"))


@query("recipient_profile", "WITH d AS (SELECT project_root_identity AS project, lower(trim(role)) AS role, byte_length, octet_length(content) AS n, sha256 FROM (SELECT DISTINCT * FROM recipient_entries)) SELECT project, count(*) AS entries, count(*) FILTER (role = 'test') AS tests, count(*) FILTER (role IS NULL) AS unnamed, count(*) FILTER (byte_length IS DISTINCT FROM n) AS wrong_length FROM d GROUP BY project")
def recipient_profile(spark: SparkSession, d: str) -> DataFrame:
    """Each recipient project: entries, tests, entries without a role, and lengths that don't hold."""
    r = table(spark, d, "recipient_entries").distinct()
    role = F.lower(F.trim("role"))
    return r.groupBy(F.col("project_root_identity").alias("project")).agg(F.count("*").alias("entries"), F.count_if(role == "test").alias("tests"), F.count_if(F.col("role").isNull()).alias("unnamed"), F.count_if(~F.col("byte_length").eqNullSafe(F.octet_length("content").cast("long"))).alias("wrong_length"))


@query("info_bundle", "WITH s AS (SELECT DISTINCT slug, qualified_name, kind FROM symbol_snapshots WHERE snapshot_no = 6), a AS (SELECT slug, count(*) AS symbols, count(*) FILTER (kind = 'class') AS classes FROM s GROUP BY slug), l AS (SELECT slug, count(DISTINCT expression) AS licences, min(expression) AS first_licence FROM license_resolution GROUP BY slug), f AS (SELECT slug, count(DISTINCT path) AS files FROM verified_bytes GROUP BY slug) SELECT slug, symbols, classes, licences, first_licence, files FROM a LEFT JOIN l USING (slug) LEFT JOIN f USING (slug)")
def info_bundle(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each repository in one row: symbols, licences and files."""
    a = table(spark, d, "symbol_snapshots").where("snapshot_no = 6").select("slug", "qualified_name", "kind").distinct().groupBy("slug").agg(F.count("*").alias("symbols"), F.count_if(F.col("kind") == "class").alias("classes"))
    licences = table(spark, d, "license_resolution").groupBy("slug").agg(F.count_distinct("expression").alias("licences"), F.min("expression").alias("first_licence"))
    files = table(spark, d, "verified_bytes").groupBy("slug").agg(F.count_distinct("path").alias("files"))
    return a.join(licences, "slug", "left").join(files, "slug", "left")


@query("tree_walk", "SELECT DISTINCT path, 'b' || md5(path) AS sha FROM verified_bytes WHERE path IS NOT NULL")
def tree_walk(spark: SparkSession, d: str) -> DataFrame:
    """All files by a walk over directory entries, which are made of their paths here."""
    parts = F.split("path", "/")
    up = lambda k: F.concat(F.lit("t"), F.md5(F.array_join(F.slice(parts, 1, k), "/").cast("binary")))
    own = F.struct(F.lit("blob").alias("kind"), F.concat(F.lit("b"), F.md5(F.col("path").cast("binary"))).alias("sha"), F.lit("100644").alias("mode"))
    entry = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(up(k - 1).alias("tree"), F.get(parts, k - 1).alias("name"), F.when(k == F.size(parts), own).otherwise(F.struct(F.lit("tree").alias("kind"), up(k).alias("sha"), F.lit("040000").alias("mode"))).alias("e")))
    entries = table(spark, d, "verified_bytes").where("path IS NOT NULL").select(F.inline(entry)).select("tree", "name", "e.*").distinct()
    root = spark.range(1).select(F.concat(F.lit("t"), F.md5(F.lit("").cast("binary"))).alias("tree"))
    return G.walk_tree(entries, root).select("path", "sha")


@query("tool_evaluation", """WITH j AS (SELECT l_orderkey AS report, '{"files":[' || string_agg('{"covered":' || CAST(l_quantity AS INTEGER) || ',"total":' || (CAST(l_quantity AS INTEGER) + l_linenumber) || '}', ',' ORDER BY l_linenumber) || ']}' AS doc FROM lineitem GROUP BY l_orderkey), f AS (SELECT report, unnest(CAST(doc -> '$.files' AS JSON[])) AS x FROM j), s AS (SELECT report, sum(CAST(x ->> '$.covered' AS BIGINT)) AS n, sum(CAST(x ->> '$.total' AS BIGINT)) AS t FROM f GROUP BY report)
SELECT report, CAST(n AS BIGINT) AS numerator, CAST(t AS BIGINT) AS denominator, CASE WHEN t = 0 THEN 'unknown' WHEN n * 10000 >= t * 8000 THEN 'pass' ELSE 'fail' END AS status FROM s""")
def tool_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Reports of a coverage tool, made of order lines, as ratio checks of at least 80 percent."""
    part = F.to_json(F.struct(F.col("l_quantity").cast("int").alias("covered"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("total")))
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("report")).agg(F.concat(F.lit('{"files":['), F.array_join(F.collect_list(part), ","), F.lit("]}")).alias("doc"))
    return C.tool_ratio(docs, "report", "doc", "$.files", "$.covered", "$.total", 8000)
