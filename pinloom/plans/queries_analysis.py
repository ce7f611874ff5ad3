"""Queries of differences, overlaps, scores, ranks and digests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.functions import digests as H
from pinloom.functions import scalars as S
from pinloom.operators import diff as D
from pinloom.operators import overlap as O
from pinloom.operators import ranking as R
from pinloom.operators import scores as C
from pinloom.plans.registry import query
from pinloom.sources.tables import table


def files(spark: SparkSession, d: str) -> DataFrame:
    """The pinned files, each once."""
    return table(spark, d, "verified_bytes").groupBy("slug", "commit_sha", "path").agg(F.min("content").alias("content"))


FILES = "files AS (SELECT slug, commit_sha, path, min(content) AS content, min(octet_length(content)) AS size FROM verified_bytes GROUP BY slug, commit_sha, path)"
BLOB_SHA = r"sha1(encode('blob ' || size) || '\x00'::BLOB || content)"


@query("blob_sha", f"WITH {FILES} SELECT slug, commit_sha, path, {BLOB_SHA} AS blob_sha, CAST(size AS BIGINT) AS size FROM files")
def blob_sha(spark: SparkSession, d: str) -> DataFrame:
    """The SHA-1 that git gives each file."""
    return files(spark, d).select("slug", "commit_sha", "path", H.git_blob_sha(F.col("content")).alias("blob_sha"), F.octet_length("content").cast("long").alias("size"))


@query("verified_blobs", f"WITH t AS (SELECT DISTINCT file_id, content, octet_length(content) AS size, blob_sha FROM verified_bytes) SELECT file_id, {BLOB_SHA} = blob_sha AS verified FROM t")
def verified_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Whether each file's bytes have the recorded SHA; null where none is recorded."""
    t = table(spark, d, "verified_bytes").select("file_id", "content", "blob_sha").distinct()
    return H.verified(t).select("file_id", "verified")


@query("tree_digests", f"""WITH {FILES}, x AS (SELECT *, {BLOB_SHA} AS sha, sha256(content) AS d FROM files)
SELECT slug, commit_sha, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, sha256(string_agg('100644 ' || path || chr(0) || sha || chr(10), '' ORDER BY '100644 ' || path || chr(0) || sha || chr(10))) AS tree_sha,
'h1:' || base64(unhex(sha256(string_agg(d || '  ' || path || chr(10), '' ORDER BY path, d)))) AS h1 FROM x GROUP BY slug, commit_sha""")
def tree_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the whole tree of each pin."""
    t = files(spark, d).withColumn("sha", H.git_blob_sha(F.col("content"))).withColumn("size", F.octet_length("content")).withColumn("_d", F.sha2("content", 256)).drop("content")
    return H.tree_digests(t, ["slug", "commit_sha"], "path", "sha", "size")


_SIDES = "a AS (SELECT DISTINCT path, sha256(min(content)) AS v FROM verified_bytes GROUP BY path), b AS (SELECT DISTINCT path, sha256(min(content)) AS v FROM recipient_entries GROUP BY path)"


def _tree(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).groupBy("path").agg(F.sha2(F.min("content"), 256).alias("v"))


@query("tree_diff", f"WITH {_SIDES} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.v IS DISTINCT FROM b.v")
def tree_diff(spark: SparkSession, d: str) -> DataFrame:
    """The pinned files against those of the recipients, by path."""
    return D.tree_diff(_tree(spark, d, "verified_bytes"), _tree(spark, d, "recipient_entries"), ["path"], "v")


@query("supplied_files", f"WITH {_SIDES} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'absent' WHEN a.path IS NULL THEN 'skipped' WHEN a.v = b.v THEN 'verified' ELSE 'mismatch' END AS state FROM a FULL JOIN b ON a.path = b.path")
def supplied_files(spark: SparkSession, d: str) -> DataFrame:
    """Supplied files against the declared map."""
    return D.declared_against_supplied(_tree(spark, d, "verified_bytes"), _tree(spark, d, "recipient_entries"), ["path"], "v")


def _snapshot(spark: SparkSession, d: str, n: int) -> DataFrame:
    return table(spark, d, "symbol_snapshots").where(F.col("snapshot_no") == n)


_SYMBOLS = "a AS (SELECT DISTINCT slug, qualified_name, kind, path, line, signature FROM symbol_snapshots WHERE snapshot_no = 1), b AS (SELECT DISTINCT slug, qualified_name, kind, path, line, signature FROM symbol_snapshots WHERE snapshot_no = 6)"


@query("parity_verdict", f"""WITH {_SYMBOLS}, x AS (SELECT slug, qualified_name, min(signature) AS v FROM a GROUP BY ALL), y AS (SELECT slug, qualified_name, min(signature) AS v FROM b GROUP BY ALL),
z AS (SELECT coalesce(x.slug, y.slug) AS slug, x.slug IS NOT NULL AND y.slug IS NOT NULL AS c, x.v IS DISTINCT FROM y.v AS df, y.slug IS NULL AS ol, x.slug IS NULL AS r FROM x FULL JOIN y ON x.slug = y.slug AND x.qualified_name = y.qualified_name),
w AS (SELECT slug, count(*) FILTER (c) AS files_compared, count(*) FILTER (c AND df) AS differing, count(*) FILTER (ol) AS only_left, count(*) FILTER (r) AS only_right FROM z GROUP BY slug)
SELECT *, CASE WHEN differing = 0 AND only_left = 0 AND only_right = 0 THEN 'exact' ELSE 'drift' END AS parity FROM w""")
def parity_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Per repository whether the first and the last snapshot agree."""
    side = lambda n: _snapshot(spark, d, n).groupBy("slug", "qualified_name").agg(F.min("signature").alias("v"))
    return D.parity(side(1), side(6), ["slug"], "qualified_name", "v")


@query("api_diff", f"""WITH {_SYMBOLS}, x AS (SELECT slug, qualified_name, count(*) AS n, min(signature) AS s, first(kind ORDER BY path, line, signature NULLS FIRST, kind) AS k FROM a GROUP BY ALL), y AS (SELECT slug, qualified_name, count(*) AS n, min(signature) AS s, first(kind ORDER BY path, line, signature NULLS FIRST, kind) AS k FROM b GROUP BY ALL),
z AS (SELECT coalesce(x.slug, y.slug) AS slug, coalesce(x.qualified_name, y.qualified_name) AS qualified_name, CASE WHEN x.n IS NULL THEN 'added' WHEN y.n IS NULL THEN 'removed' WHEN x.n = 1 AND y.n = 1 AND x.s <> y.s THEN 'changed' END AS change, coalesce(y.k, x.k) AS kind FROM x FULL JOIN y ON x.slug = y.slug AND x.qualified_name = y.qualified_name)
SELECT * FROM z WHERE change IS NOT NULL""")
def api_diff(spark: SparkSession, d: str) -> DataFrame:
    """What changed in the interfaces between the first and the last snapshot."""
    side = lambda n: _snapshot(spark, d, n).select("slug", "qualified_name", "kind", "path", "line", "signature").distinct()
    return D.api_diff(side(1), side(6), ["slug", "qualified_name"], "signature", ["path", "line"], ["kind"])


@query("drift_report", f"""WITH {_SYMBOLS}, m AS (SELECT slug, qualified_name, min(path) AS path, min(line) AS line FROM (SELECT DISTINCT slug, qualified_name, path, line FROM a) GROUP BY ALL HAVING count(*) = 1), o AS (SELECT slug, qualified_name, count(*) AS n, min(path) AS p, min(line) AS q FROM (SELECT DISTINCT slug, qualified_name, path, line FROM b) GROUP BY ALL)
SELECT m.slug, m.qualified_name, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN m.path IS NOT DISTINCT FROM p AND m.line IS NOT DISTINCT FROM q THEN 'same' ELSE 'changed' END AS state FROM m LEFT JOIN o ON m.slug = o.slug AND m.qualified_name = o.qualified_name""")
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    """Where the symbols of the first snapshot stand in the last."""
    side = lambda n: _snapshot(spark, d, n).select("slug", "qualified_name", "path", "line").distinct()
    once = side(1).groupBy("slug", "qualified_name").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.min("line").alias("line")).where("n = 1").drop("n")
    return D.drift(once, side(6), ["slug", "qualified_name"], ["path", "line"])


_HITS = "h AS (SELECT DISTINCT slug, path, md5(coalesce(signature, '')) AS commit_sha, md5(coalesce(docstring, '')) AS blob_sha FROM symbol_snapshots)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "symbol_snapshots")
    return t.select("slug", "path", F.md5(F.coalesce("signature", F.lit("")).cast("binary")).alias("commit_sha"), F.md5(F.coalesce("docstring", F.lit("")).cast("binary")).alias("blob_sha")).distinct()


_DEDUP = f"""WITH {_HITS}, k AS (SELECT slug, commit_sha, path, min(blob_sha) AS blob_sha FROM h GROUP BY slug, commit_sha, path),
p AS (SELECT *, row_number() OVER (PARTITION BY slug, path ORDER BY commit_sha, blob_sha) AS rn FROM k), q AS (SELECT *, row_number() OVER (PARTITION BY blob_sha ORDER BY slug, commit_sha, path) AS rn2, count(*) OVER (PARTITION BY blob_sha) AS group_size FROM p WHERE rn = 1)"""


@query("hit_dedup", _DEDUP + " SELECT slug, commit_sha, path, blob_sha, group_size FROM q WHERE rn2 = 1")
def hit_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Hits without disagreeing pins, one for each path and content."""
    return D.dedup_hits(_hits(spark, d)).select("slug", "commit_sha", "path", "blob_sha", "group_size")


@query("hit_dedup_counts", _DEDUP + " SELECT (SELECT count(*) FROM h) AS hits, (SELECT count(*) FROM h) - (SELECT count(*) FROM k) AS pin_disagreements, (SELECT count(*) FROM k) - (SELECT count(*) FROM q WHERE rn2 = 1) AS collapsed, (SELECT count(*) FROM q WHERE rn2 = 1) AS survivors")
def hit_dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many hits each pass dropped."""
    return D.dedup_counts(_hits(spark, d)).select(*[F.col(c).cast("long") for c in ("hits", "pin_disagreements", "collapsed", "survivors")])


_SPANS = "s AS (SELECT l_suppkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS a, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_quantity AS BIGINT) AS b FROM lineitem)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    a = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    return table(spark, d, "lineitem").select("l_suppkey", a.alias("a"), (a + F.col("l_quantity").cast("long")).alias("b"))


@query("line_union", f"WITH {_SPANS}, e AS (SELECT DISTINCT l_suppkey, unnest(range(a, b + 1)) AS n FROM s) SELECT l_suppkey, count(*) AS lines FROM e GROUP BY l_suppkey")
def line_union(spark: SparkSession, d: str) -> DataFrame:
    """How many lines the spans of each supplier cover."""
    return O.line_union(_spans(spark, d), ["l_suppkey"], "a", "b")


@query("span_overlap", f"""WITH {_SPANS}, u AS (SELECT l_suppkey, a, b, count(*) AS copies FROM s GROUP BY ALL), p AS (SELECT x.l_suppkey, x.a AS a_start, x.b AS a_end, y.a AS b_start, y.b AS b_end, x.copies AS a_copies, y.copies AS b_copies, least(x.b, y.b) - greatest(x.a, y.a) + 1 AS overlap, greatest(x.b, y.b) - least(x.a, y.a) + 1 AS union_ FROM u x JOIN u y ON x.l_suppkey = y.l_suppkey AND y.a <= x.b AND x.a <= y.b AND (x.a < y.a OR (x.a = y.a AND x.b < y.b)))
SELECT l_suppkey, a_start, a_end, b_start, b_end, a_copies, b_copies, overlap, union_ AS "union" FROM p WHERE overlap * 10000 >= union_ * 8000""")
def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a supplier that agree in four fifths of their lines."""
    return O.similar_spans(_spans(spark, d), ["l_suppkey"], "a", "b", 8000)


#: Order lines as dependencies: a customer group as the pin, the part as the name, the supplier as the version.
DEPENDENCIES = "deps AS (SELECT l_returnflag AS ecosystem, 'p' || l_partkey AS name, 's' || l_suppkey AS version, 'o' || l_orderkey % 500 AS slug, 'c' AS commit_sha, CASE WHEN l_linenumber % 3 > 0 THEN 'h' || l_linenumber % 2 END AS resolved_sha FROM lineitem)"


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    named = lambda letter, c: F.concat(F.lit(letter), F.expr(c).cast("string"))
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("ecosystem"), named("p", "l_partkey").alias("name"), named("s", "l_suppkey").alias("version"), named("o", "l_orderkey % 500").alias("slug"),
        F.lit("c").alias("commit_sha"), F.when(F.col("l_linenumber") % 3 > 0, named("h", "l_linenumber % 2")).alias("resolved_sha"),
    )


@query("dependency_overlap", f"""WITH {DEPENDENCIES}, p AS (SELECT ecosystem, name, version, slug, commit_sha, max(resolved_sha) AS sha FROM deps GROUP BY ALL), g AS (SELECT ecosystem, name, version, count(*) AS pins, count(sha) AS resolved, min(sha) AS lo, max(sha) AS hi FROM p GROUP BY ALL)
SELECT ecosystem, name, version, pins, resolved, CASE WHEN resolved > 1 AND lo = hi THEN 'resolved_equal' WHEN resolved > 1 THEN 'resolved_different' ELSE 'declared_equal' END AS strength FROM g WHERE pins > 1""")
def dependency_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies that pins share."""
    return O.dependency_overlap(_dependencies(spark, d))


@query("version_clash", f"WITH {DEPENDENCIES}, p AS (SELECT ecosystem, name, version, count(*) AS n FROM deps GROUP BY ALL) SELECT ecosystem, name, count(*) AS versions, CAST(sum(n) AS BIGINT) AS declarations, min(version) AS lowest, max(version) AS highest FROM p GROUP BY ecosystem, name HAVING count(*) > 1")
def version_clash(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies declared in several versions."""
    return O.version_clashes(_dependencies(spark, d))


@query("closure_dedup", "SELECT slug, commit_sha, ecosystem, name, version, spec, max(resolved_sha) AS resolved_sha FROM declared_dependencies GROUP BY slug, commit_sha, ecosystem, name, version, spec")
def closure_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each dependency edge once."""
    return O.closure_dedup(table(spark, d, "declared_dependencies"))


_MODULES = "a AS (SELECT DISTINCT module FROM symbol_snapshots WHERE module IS NOT NULL AND snapshot_no = 1), b AS (SELECT DISTINCT qualified_name AS module FROM symbol_snapshots WHERE snapshot_no = 6 AND kind = 'class')"


@query("namespace_conflicts", f"WITH {_MODULES} SELECT DISTINCT a.module FROM a JOIN b ON a.module = b.module OR starts_with(a.module, b.module || '.') OR starts_with(b.module, a.module || '.')")
def namespace_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Modules that stand above, below or at the name of a class."""
    ours = _snapshot(spark, d, 1).where("module IS NOT NULL").select("module")
    return O.namespace_conflicts(ours, _snapshot(spark, d, 6).where("kind = 'class'").select(F.col("qualified_name").alias("module")), "module")


@query("trust_score", """WITH p AS (SELECT slug, max(struct_pack(a := delivered_at, b := parity, c := checksum, d := artifact_kind, e := files_compared)) AS r, min(delivered_at) AS first_at FROM parity_results WHERE snapshot_no = 6 GROUP BY slug)
SELECT p.slug, CAST(greatest(0, least(100, floor((50 + (CASE WHEN r.e > 100 THEN 100 WHEN r.e > 10 THEN 70 ELSE 50 END) * 20 + (CASE r.b WHEN 'exact' THEN 100 WHEN 'drift' THEN 0 ELSE 50 END) * 15 + (CASE q.c WHEN 3 THEN 100 WHEN 2 THEN 65 WHEN 1 THEN 25 ELSE 50 END) * 15 + (CASE WHEN r.c IS NULL THEN 0 ELSE 60 END) * 10 + (CASE WHEN f.t THEN 100 WHEN NOT f.t THEN 0 ELSE 50 END) * 10 + (CASE WHEN r.c IS NOT NULL AND r.d IS NOT NULL THEN 100 ELSE 0 END) * 15
+ (CASE WHEN first_at IS NULL OR r.a IS NULL OR first_at > r.a THEN 50 ELSE 100 END) * 15) / 100))) AS INTEGER) AS trust FROM p LEFT JOIN (SELECT slug, max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END) AS c FROM license_resolution GROUP BY slug) q ON q.slug = p.slug
LEFT JOIN (SELECT slug, bool_or(starts_with(path, 'tests/')) AS t FROM verified_bytes WHERE path IS NOT NULL GROUP BY slug) f ON f.slug = p.slug""")
def trust_score(spark: SparkSession, d: str) -> DataFrame:
    """The trust of each repository from its last parity row."""
    r = F.struct(F.col("delivered_at").alias("a"), F.col("parity").alias("b"), F.col("checksum").alias("c"), F.col("artifact_kind").alias("d"), F.col("files_compared").alias("e"))
    p = table(spark, d, "parity_results").where("snapshot_no = 6").groupBy("slug").agg(F.max(r).alias("r"), F.min("delivered_at").alias("first_at"))
    licences = table(spark, d, "license_resolution").groupBy("slug").agg(F.max(F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1)).alias("_c"))
    tests = table(spark, d, "verified_bytes").where("path IS NOT NULL").groupBy("slug").agg(F.bool_or(F.col("path").startswith("tests/")).alias("_t"))
    p = p.join(licences, "slug", "left").join(tests, "slug", "left")
    confidence = F.when(F.col("_c") == 3, "high").when(F.col("_c") == 2, "medium").when(F.col("_c") == 1, "low")
    verification = F.when(F.col("r.e") > 100, "true").when(F.col("r.e") > 10, "sampled")
    docs = F.when(F.col("r.c").isNull(), 0).otherwise(1)
    return p.select("slug", C.trust_score(verification, F.col("r.b"), confidence, docs, F.col("_t"), F.col("r.c").isNotNull() & F.col("r.d").isNotNull(), F.col("first_at"), F.col("r.a")).alias("trust"))


_CHECKS = "c AS (SELECT o_custkey % 50 AS g, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' WHEN 'P' THEN 'unknown' ELSE 'not_applicable' END AS status, CAST(floor(o_totalprice) AS BIGINT) % 10001 AS score_bps, 1 + o_orderkey % 9 AS weight, o_orderpriority LIKE '1%' AS required FROM orders)"


def _checks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").when(F.col("o_orderstatus") == "P", "unknown").otherwise("not_applicable")
    return o.select((F.col("o_custkey") % 50).alias("g"), status.alias("status"), (F.floor("o_totalprice").cast("long") % 10001).alias("score_bps"), (1 + F.col("o_orderkey") % 9).alias("weight"), F.col("o_orderpriority").like("1%").alias("required"))


@query("weighted_bounds", f"""WITH {_CHECKS}, s AS (SELECT g, coalesce(sum(weight) FILTER (status <> 'not_applicable'), 0) AS e, coalesce(sum(weight) FILTER (status IN ('pass', 'fail')), 0) AS i, coalesce(sum(weight * score_bps) FILTER (status IN ('pass', 'fail')), 0) AS k FROM c GROUP BY g)
SELECT g, CAST(e AS BIGINT) AS eligible_weight, CAST(i AS BIGINT) AS included_weight, CASE WHEN e > 0 AND i = e THEN CAST((2 * k + i) // (2 * i) AS BIGINT) END AS score_bps, CASE WHEN e > 0 AND i > 0 THEN CAST((2 * k + i) // (2 * i) AS BIGINT) END AS observed_bps, CASE WHEN e > 0 THEN CAST((2 * k + e) // (2 * e) AS BIGINT) END AS lower_bps, CASE WHEN e > 0 THEN CAST((2 * (k + 10000 * (e - i)) + e) // (2 * e) AS BIGINT) END AS upper_bps FROM s""")
def weighted_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Scores of groups of checks with bounds for what is unresolved."""
    return C.weighted_bounds(_checks(spark, d), ["g"])


@query("gate_verdict", f"WITH {_CHECKS} SELECT g, CASE WHEN bool_or(required AND status = 'fail') THEN 'fail' WHEN bool_or(required AND status NOT IN ('pass', 'fail', 'not_applicable')) THEN 'indeterminate' ELSE 'pass' END AS verdict FROM c GROUP BY g")
def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The verdict of each group's required checks."""
    return C.gate_verdict(_checks(spark, d), ["g"], F.col("required"))


@query("micro_macro", """WITH m AS (SELECT l_returnflag AS lang, l_orderkey AS task, count(*) FILTER (l_discount >= 0.05) AS numerator, count(*) AS denominator FROM lineitem GROUP BY ALL)
SELECT lang, CAST(sum(numerator) AS BIGINT) AS numerator, CAST(sum(denominator) AS BIGINT) AS denominator, CAST((20000 * sum(numerator) + sum(denominator)) // (2 * sum(denominator)) AS BIGINT) AS score_bps, round(avg(numerator / denominator), 9) AS macro FROM m GROUP BY lang""")
def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    """Micro and macro averages of a ratio over tasks, by stratum."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("lang"), F.col("l_orderkey").alias("task")).agg(F.count_if(F.col("l_discount") >= 0.05).alias("numerator"), F.count("*").alias("denominator"))
    macro = m.groupBy("lang").agg(F.round(F.avg(F.col("numerator") / F.col("denominator")), 9).alias("macro"))
    return C.micro_average(m, ["lang"]).join(macro, "lang")


_RUN = """run AS (SELECT o_custkey AS task, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
judged AS (SELECT o_custkey AS task, o_orderkey AS item, CASE left(o_orderpriority, 1) WHEN '1' THEN 2 WHEN '2' THEN 1 ELSE 0 END AS grade, o_custkey % 2 = 0 AS complete FROM orders WHERE o_orderkey % 3 <> 0)"""


@query("retrieval_metrics", f"""WITH {_RUN}, i AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY grade DESC, item) AS p FROM judged),
w AS (SELECT task, sum(grade / log2(p + 1)) FILTER (p <= 10) AS ideal, count(*) FILTER (grade >= 1) AS useful, bool_and(complete) AS complete FROM i GROUP BY task HAVING max(grade) = 2),
g AS (SELECT r.task, r.rank, coalesce(j.grade, 0) AS grade FROM run r LEFT JOIN judged j ON r.task = j.task AND r.item = j.item WHERE r.rank <= 10), h AS (SELECT *, count(*) FILTER (grade >= 1) OVER (PARTITION BY task ORDER BY rank) AS hits FROM g),
s AS (SELECT task, sum(grade / log2(rank + 1)) AS dcg, min(rank) FILTER (grade = 2) AS exact, count(*) FILTER (grade >= 1) AS found, count(*) FILTER (grade >= 1 AND rank <= 5) AS found5, sum(hits / rank) FILTER (grade >= 1) AS ps FROM h GROUP BY task)
SELECT w.task, round(coalesce(dcg, 0) / ideal, 9) AS ndcg, round(coalesce(1.0 / exact, 0), 9) AS rr, coalesce(CAST(exact <= 1 AS DOUBLE), 0) AS success_1, coalesce(CAST(exact <= 5 AS DOUBLE), 0) AS success_5, coalesce(CAST(exact <= 10 AS DOUBLE), 0) AS success_10, round(coalesce(found, 0) / useful, 9) AS recall,
CASE WHEN complete THEN coalesce(found5, 0) / 5.0 END AS precision_5, CASE WHEN complete THEN coalesce(found, 0) / 10.0 END AS precision_10, CASE WHEN complete THEN round(coalesce(ps, 0) / least(useful, 10), 9) END AS ap FROM w LEFT JOIN s USING (task)""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The measures of a ranked run against graded judgments."""
    o = table(spark, d, "orders")
    run = C.top_k_each(o.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("item"), "o_totalprice"), ["task"], [F.col("o_totalprice").desc(), F.col("item")], 10).select("task", "item", "rank")
    first = F.left("o_orderpriority", F.lit(1))
    judged = o.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("item"), F.when(first == "1", 2).when(first == "2", 1).otherwise(0).alias("grade"), (F.col("o_custkey") % 2 == 0).alias("complete"))
    out = R.retrieval_metrics(run, judged)
    return out.select("task", *[F.round(c, 9).alias(c) if c in ("ndcg", "rr", "recall", "ap") else F.col(c) for c in out.columns[1:]])


@query("phase_statistics", "SELECT event_type AS phase, count(*) AS samples, min(value) AS least, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS greatest, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def phase_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counts, nearest-rank percentiles and totals by phase."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("phase")).agg(
        F.count("*").alias("samples"), F.min("value").alias("least"), R.nearest_rank("value", 0.5).alias("p50"), R.nearest_rank("value", 0.95).alias("p95"),
        F.max("value").alias("greatest"), F.round(F.sum("value"), 4).alias("total"),
    )


#: The U test by exact counts; two-sided p below a level means z above a quantile.
_U = """e AS (SELECT event_type, value, user_id % 2 = 0 AS a FROM events WHERE value IS NOT NULL), c AS (SELECT event_type, value, count(*) AS n, count(*) FILTER (a) AS x, count(*) FILTER (NOT a) AS y FROM e GROUP BY ALL),
k AS (SELECT *, 2 * coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n + 1 AS r FROM c),
g AS (SELECT event_type, CAST(sum(x) AS BIGINT) AS n_first, CAST(sum(y) AS BIGINT) AS n_second, CAST(sum(r * x) AS DOUBLE) AS rs, CAST(sum(CAST(n AS HUGEINT) * n * n - n) AS DOUBLE) AS ties FROM k GROUP BY event_type),
h AS (SELECT *, least(rs - n_first * (n_first + 1), 2.0 * n_first * n_second - (rs - n_first * (n_first + 1))) / 2 AS u, n_first * n_second / 12.0 * (n_first + n_second + 1 - ties / ((n_first + n_second) * (n_first + n_second - 1.0))) AS v FROM g),
t AS (SELECT event_type, n_first, n_second, u, CASE WHEN v = 0 THEN 0 ELSE greatest(0, abs(u - n_first * n_second / 2.0) - 0.5) / sqrt(v) END AS z FROM h)"""
#: The quantile of z for a two-sided level of 0.002.
_Z = 3.090232306167813


@query("mann_whitney", f"WITH {_U} SELECT event_type, n_first, n_second, u, round(z, 7) AS z, z > {_Z} AS significant FROM t")
def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    """Whether two halves of the users differ in value, by event type."""
    e = table(spark, d, "events").withColumn("half", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    out = R.mann_whitney(e, ["event_type"], "half", "a", "b", "value")
    return out.select("event_type", "n_first", "n_second", "u", F.round("z", 7).alias("z"), (F.col("p_value") < 0.002).alias("significant"))


@query("tie_ranks", "WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_quantity, CAST(2 * coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n + 1 AS BIGINT) AS doubled_rank FROM c")
def tie_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Mid-ranks of quantities within their flag, doubled."""
    return R.tie_ranks(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", "l_quantity", "doubled_rank")


@query("regression_gate", f"""WITH {_U}, s AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS n1, count(*) FILTER (user_id % 2 = 1) AS n2, quantile_disc(value, 0.5) FILTER (user_id % 2 = 0) AS m1, quantile_disc(value, 0.5) FILTER (user_id % 2 = 1) AS m2 FROM events GROUP BY event_type)
SELECT event_type, m1 AS baseline, m2 AS candidate, CASE WHEN n1 < 6 OR n2 < 6 THEN 'unknown' WHEN m2 <= 1.001 * m1 THEN 'pass' WHEN z > {_Z} THEN 'fail' ELSE 'pass' END AS decision FROM s JOIN t USING (event_type)""")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the candidate half of the users is slower: with a tolerance of a thousandth, so that the test decides for some."""
    e = table(spark, d, "events").withColumn("half", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    return R.regression_decision(e, "event_type", "half", "a", "b", "value", 1.001).select("event_type", "baseline", "candidate", "decision")


_BEST = "p AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size END AS a, CAST(p_retailprice * 100 AS BIGINT) AS b, CASE WHEN p_partkey % 1000 = 0 THEN NULL ELSE p_partkey % 7 END AS c FROM part)"


@query("best3_roles", f"""WITH {_BEST}, d AS (SELECT *, (SELECT max(b) FROM p) AS mb FROM p)
SELECT 'price' AS role, CASE WHEN (SELECT count(*) FROM p WHERE b = (SELECT max(b) FROM p)) > 1 THEN 'equal_identity_tiebreak' ELSE 'proved_winner' END AS status, (SELECT min(p_partkey) FROM p WHERE b = (SELECT max(b) FROM p)) AS winner
UNION ALL SELECT 'size', 'unranked_incomparable', NULL
UNION ALL SELECT 'price_then_size', CASE WHEN EXISTS (SELECT 1 FROM p x JOIN p y ON x.b = y.b AND x.p_partkey <> y.p_partkey AND (x.a IS NULL OR y.a IS NULL)) THEN 'unranked_incomparable' ELSE 'proved_winner' END, CASE WHEN NOT EXISTS (SELECT 1 FROM p x JOIN p y ON x.b = y.b AND x.p_partkey <> y.p_partkey AND (x.a IS NULL OR y.a IS NULL)) THEN (SELECT min(p_partkey) FROM p WHERE b = (SELECT max(b) FROM p)) END""")
def best3_roles(spark: SparkSession, d: str) -> DataFrame:
    """The winner of each role, or why there is none."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("a"), F.round(F.col("p_retailprice") * 100).cast("long").alias("b"))
    return C.lexicographic_winners(p, "p_partkey", {"price": [F.col("b")], "size": [F.col("a")], "price_then_size": [F.col("b"), F.col("a")]})


@query("top_symbols", "WITH s AS (SELECT DISTINCT slug, qualified_name, name, kind, path, line FROM symbol_snapshots WHERE snapshot_no = 6) SELECT slug, qualified_name, kind FROM s ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 WHEN 'constant' THEN 3 ELSE 4 END, name, qualified_name, slug, path, line LIMIT 50")
def top_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The fifty leading symbols."""
    s = _snapshot(spark, d, 6).select("slug", "qualified_name", "name", "kind", "path", "line").distinct()
    rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).when(F.col("kind") == "method", 2).when(F.col("kind") == "constant", 3).otherwise(4)
    return C.top_k(s, [rank, F.col("name").asc_nulls_last(), F.col("qualified_name").asc_nulls_last(), F.col("slug").asc_nulls_last(), F.col("path").asc_nulls_last(), F.col("line").asc_nulls_last()], 50).select("slug", "qualified_name", "kind")


@query("symbol_counts", "SELECT slug, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'method') AS methods, count(*) FILTER (kind = 'constant') AS constants FROM (SELECT DISTINCT slug, qualified_name, kind FROM symbol_snapshots WHERE snapshot_no = 6) GROUP BY slug")
def symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by kind, in fixed buckets."""
    s = _snapshot(spark, d, 6).select("slug", "qualified_name", "kind").distinct()
    return s.groupBy("slug").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("class", "classes"), ("function", "functions"), ("method", "methods"), ("constant", "constants"))])


@query("public_symbols", "SELECT slug, name AS symbol FROM symbol_snapshots WHERE snapshot_no = 6 AND name IS NOT NULL UNION SELECT slug, qualified_name FROM symbol_snapshots WHERE snapshot_no = 6 AND qualified_name IS NOT NULL")
def public_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The names that examples may mention."""
    return _snapshot(spark, d, 6).select("slug", F.explode(F.array("name", "qualified_name")).alias("symbol")).where("symbol IS NOT NULL").distinct()


@query("license_routing", "WITH e AS (SELECT slug, source_path, list_distinct(list(canonical_expression) FILTER (canonical_expression IS NOT NULL)) AS x FROM license_evidence GROUP BY slug, source_path) SELECT slug, source_path, CASE WHEN list_has_any(x, ['GPL-3.0-only', 'AGPL-3.0-only']) THEN 'reject' WHEN len(coalesce(x, [])) = 0 OR list_has_any(x, ['GPL-2.0-or-later', 'LGPL-2.1-only']) THEN 'study' ELSE 'reuse' END AS route FROM e")
def license_routing(spark: SparkSession, d: str) -> DataFrame:
    """Where each source may go, by the most restrictive of its licences."""
    e = table(spark, d, "license_evidence").groupBy("slug", "source_path").agg(F.collect_set("canonical_expression").alias("x"))
    return e.select("slug", "source_path", C.license_route(F.col("x"), ["GPL-3.0-only", "AGPL-3.0-only"], ["GPL-2.0-or-later", "LGPL-2.1-only"]).alias("route"))


@query("license_decision", """WITH r AS (SELECT DISTINCT slug, source_path, expression, state FROM license_resolution), v AS (SELECT *, CASE WHEN expression = 'GPL-3.0-only' THEN 'incompatible' WHEN state IS DISTINCT FROM 'resolved' THEN 'unknown' WHEN expression IS NULL OR expression NOT IN ('MIT', 'ISC', 'Apache-2.0', 'MPL-2.0') THEN 'unknown' WHEN expression = 'MPL-2.0' THEN 'incompatible' ELSE 'pass' END AS d FROM r),
k AS (SELECT *, CASE WHEN expression = 'GPL-3.0-only' THEN 0 WHEN d <> 'pass' THEN 1 ELSE 2 END AS o FROM v) SELECT slug, first(d ORDER BY o, source_path, d) AS decision FROM k WHERE slug IS NOT NULL AND source_path IS NOT NULL GROUP BY slug""")
def license_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether a repository's licences allow it, the first reason deciding."""
    r = table(spark, d, "license_resolution").where("slug IS NOT NULL AND source_path IS NOT NULL").select("slug", "source_path", "expression", "state").distinct()
    one = r.withColumn("state", F.coalesce("state", F.lit("none")))
    # files of several rows are settled by the text order of what they lead to
    e = F.col("expression")
    verdict = F.when(F.coalesce(e == "GPL-3.0-only", F.lit(False)), "incompatible").when(F.col("state") != "resolved", "unknown").when(~F.coalesce(e.isin("MIT", "ISC", "Apache-2.0", "MPL-2.0"), F.lit(False)), "unknown").when(e == "MPL-2.0", "incompatible").otherwise("pass")
    ordered = one.withColumn("o", F.struct("source_path", verdict))
    return C.license_decision(ordered, ["slug"], "o", "expression", "state", ["GPL-3.0-only"], ["MIT", "ISC", "Apache-2.0", "MPL-2.0"], ["MIT", "ISC", "Apache-2.0"])


@query("coordinates", r"""SELECT DISTINCT ecosystem, name, version, regexp_replace(lower(name), '[-_.]+', '-', 'g') AS normal, lower(regexp_replace(name, '([A-Z])', '!\1', 'g')) AS escaped, CASE WHEN regexp_matches(version, '^v?[0-9]+(\.[0-9]+)*$') THEN list_transform(string_split(ltrim(version, 'v'), '.'), lambda x: CAST(x AS BIGINT)) END AS parts FROM declared_dependencies""")
def coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Names and versions of dependencies in their canonical forms."""
    t = table(spark, d, "declared_dependencies").select("ecosystem", "name", "version").distinct()
    return t.select("*", S.normal_package(F.col("name")).alias("normal"), S.escaped_module(F.col("name")).alias("escaped"), S.version_parts(F.col("version")).alias("parts"))


@query("package_urls", "SELECT DISTINCT ecosystem, name, version, 'pkg:' || lower(ecosystem) || '/' || replace(url_encode(name), '%2F', '/') || CASE WHEN version IS NULL THEN '' ELSE '@' || url_encode(version) END AS purl FROM declared_dependencies")
def package_urls(spark: SparkSession, d: str) -> DataFrame:
    """Package addresses of the dependencies."""
    t = table(spark, d, "declared_dependencies").select("ecosystem", "name", "version").distinct()
    return t.select("*", S.package_url(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"))


@query("stable_release", r"""WITH t AS (SELECT DISTINCT ecosystem AS name, 'v' || version || '.0' AS tag FROM declared_dependencies WHERE regexp_matches(version, '^[0-9]+\.[0-9]+$')), k AS (SELECT *, list_transform(string_split(ltrim(tag, 'v'), '.'), lambda x: CAST(x AS BIGINT)) AS p FROM t) SELECT name, first(tag ORDER BY p[1] DESC, p[2] DESC, p[3] DESC, tag) AS latest FROM k GROUP BY name""")
def stable_release(spark: SparkSession, d: str) -> DataFrame:
    """The latest stable tag of each name."""
    t = table(spark, d, "declared_dependencies").select(F.col("ecosystem").alias("name"), F.concat(F.lit("v"), "version", F.lit(".0")).alias("tag")).distinct().withColumn("v", S.stable_version(F.col("tag"))).where("v IS NOT NULL")
    return t.groupBy("name").agg(F.max_by("tag", "v").alias("latest"))


@query("path_words", "SELECT DISTINCT path, list_sort(list_distinct(regexp_extract_all(lower(path), '[a-z0-9]+'))) AS words FROM verified_bytes")
def path_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of every path."""
    return table(spark, d, "verified_bytes").select("path").distinct().select("path", S.path_words(F.col("path")).alias("words"))


@query("stage_accounting", """WITH s AS (SELECT DISTINCT slug, qualified_name, signature, docstring FROM symbol_snapshots WHERE snapshot_no = 6) SELECT * FROM (SELECT 1 AS stage, 'collected' AS name, count(*) AS kept FROM s UNION ALL SELECT 2, 'signed', count(*) FROM s WHERE signature IS NOT NULL UNION ALL SELECT 3, 'documented', count(*) FROM s WHERE signature IS NOT NULL AND docstring IS NOT NULL UNION ALL SELECT 4, 'distinct', count(DISTINCT (slug, qualified_name)) FROM s WHERE signature IS NOT NULL AND docstring IS NOT NULL)""")
def stage_accounting(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates each stage of a funnel keeps, from one pass."""
    s = _snapshot(spark, d, 6).select("slug", "qualified_name", "signature", "docstring").distinct()
    signed, documented = F.col("signature").isNotNull(), F.col("signature").isNotNull() & F.col("docstring").isNotNull()
    key = s.groupBy("slug", "qualified_name").agg(F.count("*").alias("a"), F.count_if(signed).alias("b"), F.count_if(documented).alias("c"))
    one = key.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("e"))
    stages = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"), F.col(c).cast("long").alias("kept")) for i, n, c in ((1, "collected", "a"), (2, "signed", "b"), (3, "documented", "c"), (4, "distinct", "e"))])
    return one.select(F.inline(stages))


@query("scores_in_bands", "WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 10001 AS b FROM orders) SELECT CASE WHEN b < 4000 THEN 'critical' WHEN b < 6000 THEN 'serious' WHEN b < 8000 THEN 'fair' ELSE 'good' END AS band, count(*) AS n FROM s GROUP BY 1")
def scores_in_bands(spark: SparkSession, d: str) -> DataFrame:
    """Scores by display band."""
    return table(spark, d, "orders").select(S.band(F.floor("o_totalprice").cast("long") % 10001).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("missing_and_unjustified", "WITH r AS (SELECT DISTINCT lower(name) AS name FROM declared_dependencies WHERE graph_kind = 'complete'), o AS (SELECT DISTINCT lower(name) AS name FROM declared_dependencies WHERE graph_kind <> 'complete') SELECT name, 'missing' AS state FROM r WHERE name NOT IN (SELECT name FROM o WHERE name IS NOT NULL) UNION ALL SELECT name, 'unjustified' FROM o WHERE name NOT IN (SELECT name FROM r WHERE name IS NOT NULL)")
def missing_and_unjustified(spark: SparkSession, d: str) -> DataFrame:
    """Required but not observed, observed but not required: two anti-joins."""
    t = table(spark, d, "declared_dependencies").select(F.lower("name").alias("name"), "graph_kind").where("name IS NOT NULL").distinct()
    r, o = t.where("graph_kind = 'complete'").select("name"), t.where("graph_kind <> 'complete'").select("name")
    return r.join(o, "name", "left_anti").withColumn("state", F.lit("missing")).unionByName(o.join(r, "name", "left_anti").withColumn("state", F.lit("unjustified")))
