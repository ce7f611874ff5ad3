"""Queries over the catalog of pinned sources, their manifests and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.functions import evidence as E
from pinloom.functions.digests import git_blob_sha
from pinloom.operators import ranking as R
from pinloom.operators import reports as Q
from pinloom.operators.graph import duplicates
from pinloom.plans.queries_search import _ADAPTER, BLOBS, COLUMNS, plain
from pinloom.plans.registry import query
from pinloom.plans.search import search
from pinloom.plans.sizing import shared_folder
from pinloom.sources import catalog as K
from pinloom.sources.blobs import document_blobs
from pinloom.sources.tables import table

#: The pins of the files as manifests (m), with what the last parity row of the repository says; and a catalog (c) from recorded evidence.
MANIFESTS = """
v AS (SELECT slug, commit_sha, max(fetched_at) AS fetched_at, count(DISTINCT path) AS files, bool_or(starts_with(path, 'tests/')) AS has_tests FROM verified_bytes WHERE slug IS NOT NULL AND commit_sha IS NOT NULL GROUP BY slug, commit_sha),
p AS (SELECT slug, max(struct_pack(a := delivered_at, b := parity, c := checksum, d := artifact_kind, e := files_compared)) AS r FROM parity_results WHERE snapshot_no = 6 GROUP BY slug),
m AS (SELECT 'github.com' AS host, split_part(v.slug, '/', 1) AS owner, split_part(v.slug, '/', 2) AS repo, commit_sha, fetched_at, files, r.b AS parity, r.c AS checksum, CASE WHEN r.d IS NULL THEN 'git-commit' ELSE 'artifact' END AS source,
  CASE WHEN r.e > 100 THEN 'full' ELSE 'sampled' END AS scope, CASE WHEN r.e > 100 THEN 'true' WHEN r.e > 10 THEN 'sampled' END AS verified, CASE WHEN files > 5 THEN 'h1:' || repeat('A', 43) || '=' END AS tree_hash,
  files * 9 AS trust, CASE WHEN has_tests THEN 'reuse' ELSE 'study' END AS route, 'npm' AS ecosystem, split_part(v.slug, '/', 2) AS name, '1.' || files AS version, 'v1.' || files AS tag, CASE WHEN has_tests THEN 'main' END AS branch FROM v LEFT JOIN p ON p.slug = v.slug),
c AS (SELECT DISTINCT 'github.com' AS host, split_part(slug, '/', 1) AS owner, split_part(slug, '/', 2) AS repo, commit_sha FROM license_evidence WHERE slug IS NOT NULL AND commit_sha IS NOT NULL)
""".strip()
_KEY = "host, owner, repo, commit_sha"


def manifests(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verified_bytes").where("slug IS NOT NULL AND commit_sha IS NOT NULL").groupBy("slug", "commit_sha").agg(F.max("fetched_at").alias("fetched_at"), F.count_distinct("path").alias("files"), F.bool_or(F.col("path").startswith("tests/")).alias("has_tests"))
    r = F.struct(F.col("delivered_at").alias("a"), F.col("parity").alias("b"), F.col("checksum").alias("c"), F.col("artifact_kind").alias("d"), F.col("files_compared").alias("e"))
    p = table(spark, d, "parity_results").where("snapshot_no = 6").groupBy("slug").agg(F.max(r).alias("r"))
    part = lambda i: F.split_part("slug", F.lit("/"), F.lit(i))
    text = lambda head: F.concat(F.lit(head), F.col("files").cast("string"))
    return v.join(p, "slug", "left").select(
        F.lit("github.com").alias("host"), part(1).alias("owner"), part(2).alias("repo"), "commit_sha", "fetched_at", "files", F.col("r.b").alias("parity"), F.col("r.c").alias("checksum"),
        F.when(F.col("r.d").isNull(), "git-commit").otherwise("artifact").alias("source"), F.when(F.col("r.e") > 100, "full").otherwise("sampled").alias("scope"), F.when(F.col("r.e") > 100, "true").when(F.col("r.e") > 10, "sampled").alias("verified"),
        F.when(F.col("files") > 5, F.lit("h1:" + "A" * 43 + "=")).alias("tree_hash"), (F.col("files") * 9).alias("trust"), F.when(F.col("has_tests"), "reuse").otherwise("study").alias("route"),
        F.lit("npm").alias("ecosystem"), part(2).alias("name"), text("1.").alias("version"), text("v1.").alias("tag"), F.when(F.col("has_tests"), "main").alias("branch"),
    )


def catalog(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.split_part("slug", F.lit("/"), F.lit(i))
    return table(spark, d, "license_evidence").where("slug IS NOT NULL AND commit_sha IS NOT NULL").select(F.lit("github.com").alias("host"), part(1).alias("owner"), part(2).alias("repo"), "commit_sha").distinct()


@query("catalog_scan", f"WITH {MANIFESTS} SELECT {_KEY}, m.fetched_at, m.files, CASE WHEN m.files IS NULL THEN 'missing_manifest' ELSE 'found' END AS state FROM c LEFT JOIN m USING ({_KEY})")
def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    """Catalog entries with their manifests, or that they have none."""
    return K.scan_catalog(catalog(spark, d), manifests(spark, d)).select(*K.KEY, "fetched_at", "files", "state")


_WANTED = ("github:ostwen/talmer-monoshelf", "github.com/ostwen/talmer-monoshelf@v1.7", "ostwen/talmer-monoshelf#main", "talmer-monoshelf", "npm:talmer-monoshelf@1.9", "pypi:talmer-monoshelf")


@query("identity_lookup", f"""WITH {MANIFESTS} SELECT '{_WANTED[0]}' AS spec, {_KEY} FROM m WHERE owner || '/' || repo = 'ostwen/talmer-monoshelf' UNION ALL SELECT '{_WANTED[1]}', {_KEY} FROM m WHERE owner || '/' || repo = 'ostwen/talmer-monoshelf' AND tag = 'v1.7'
UNION ALL SELECT '{_WANTED[2]}', {_KEY} FROM m WHERE owner || '/' || repo = 'ostwen/talmer-monoshelf' AND branch = 'main' UNION ALL SELECT '{_WANTED[3]}', {_KEY} FROM m WHERE name = 'talmer-monoshelf' UNION ALL SELECT '{_WANTED[4]}', {_KEY} FROM m WHERE name = 'talmer-monoshelf' AND (version = '1.9' OR tag = '1.9')""")
def identity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The sources that each of some specs names."""
    held = manifests(spark, d)
    parts = [K.lookup(held, K.parse_source(s)).select(F.lit(s).alias("spec"), *K.KEY) for s in _WANTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("catalog_upsert", f"WITH {MANIFESTS} SELECT {_KEY}, NULL::TIMESTAMP AS fetched_at FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.owner = c.owner AND m.repo = c.repo AND m.commit_sha = c.commit_sha) UNION ALL SELECT {_KEY}, fetched_at FROM m")
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The catalog with every manifest's entry put in."""
    base = catalog(spark, d).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    return K.upsert(base, manifests(spark, d).select(*K.KEY, "fetched_at")).withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


@query("catalog_remove", f"WITH {MANIFESTS} SELECT {_KEY} FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.owner = c.owner AND m.repo = c.repo AND m.commit_sha = c.commit_sha AND source = 'artifact')")
def catalog_remove(spark: SparkSession, d: str) -> DataFrame:
    """The catalog without the sources that came from artifacts."""
    return K.remove(catalog(spark, d), manifests(spark, d).where("source = 'artifact'"))


_PROBLEMS = """list_filter([CASE WHEN coalesce(checksum IS NULL OR regexp_matches(checksum, '^(sha(1|256|512):)?[0-9a-f]{40,128}$'), false) THEN NULL ELSE 'checksum' END, CASE WHEN regexp_matches(commit_sha, '^[0-9a-f]{40}$') THEN NULL ELSE 'commit_sha' END, CASE WHEN fetched_at IS NULL THEN 'fetched_at' END,
CASE WHEN coalesce(parity IN ('exact', 'drift', 'unknown'), false) THEN NULL ELSE 'parity' END, CASE WHEN coalesce(tree_hash LIKE 'h1:%', false) THEN NULL ELSE 'tree_hash' END, CASE WHEN coalesce(verified IN ('true', 'sampled', 'archive-only', 'false'), false) THEN NULL ELSE 'verified' END], lambda x: x IS NOT NULL)"""


@query("manifest_validation", f"WITH {MANIFESTS} SELECT {_KEY}, {_PROBLEMS} AS problems FROM m")
def manifest_validation(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each manifest."""
    return manifests(spark, d).select(*K.KEY, K.manifest_problems().alias("problems"))


@query("index_eligibility", f"WITH {MANIFESTS} SELECT {_KEY}, list_filter([CASE WHEN coalesce(parity = 'exact', false) THEN NULL ELSE 'parity' END, CASE WHEN scope = 'full' THEN NULL ELSE 'scope' END, CASE WHEN source = 'git-commit' THEN NULL ELSE 'source' END], lambda x: x IS NOT NULL) AS conditions FROM m")
def index_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """The conditions that keep each shelf from being indexed."""
    return manifests(spark, d).select(*K.KEY, K.index_problems().alias("conditions"))


@query("corpus_listing", f"WITH {MANIFESTS}, j AS (SELECT c.*, m.trust, m.route, coalesce(len({_PROBLEMS}) = 0 AND trust BETWEEN 0 AND 100, false) AS good FROM c LEFT JOIN m USING ({_KEY})) SELECT {_KEY}, CAST(trust AS INTEGER) AS trust, route, 'listed' AS state, 1::BIGINT AS n FROM j WHERE good UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'excluded', count(*) FROM j WHERE NOT good")
def corpus_listing(spark: SparkSession, d: str) -> DataFrame:
    """The listed sources with trust and route, and how many are left out."""
    return K.listing(catalog(spark, d), manifests(spark, d))


@query("pin_precedence", f"WITH {MANIFESTS} SELECT owner, repo, coalesce(CASE WHEN regexp_matches(c.commit_sha, '^[0-9a-f]{{40}}$') THEN c.commit_sha END, CASE WHEN regexp_matches(m.commit_sha, '^[0-9a-f]{{40}}$') THEN m.commit_sha END, 'none') AS pin FROM (SELECT owner, repo, CASE WHEN min(commit_sha) < '5' THEN 'HEAD' ELSE min(commit_sha) END AS commit_sha FROM c GROUP BY ALL) c FULL JOIN (SELECT owner, repo, max(commit_sha) AS commit_sha FROM m GROUP BY ALL) m USING (owner, repo)")
def pin_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The commit of each shelf: the catalog's unless it is malformed, else the manifest's."""
    least = F.min("commit_sha")
    a = catalog(spark, d).groupBy("owner", "repo").agg(F.when(least < "5", "HEAD").otherwise(least).alias("a"))
    b = manifests(spark, d).groupBy("owner", "repo").agg(F.max("commit_sha").alias("b"))
    return a.join(b, ["owner", "repo"], "full_outer").select("owner", "repo", K.pin(F.col("a"), F.col("b"), F.lit("none")).alias("pin"))


_RAW = "r AS (SELECT DISTINCT CASE graph_kind WHEN 'complete' THEN lower(ecosystem) || ':' || lower(name) || '@' || version ELSE 'github:' || slug || '@' || version END AS raw, CASE WHEN graph_kind = 'complete' THEN CASE lower(ecosystem) WHEN 'cargo' THEN 'crates' ELSE lower(ecosystem) END END AS ecosystem, CASE WHEN graph_kind = 'complete' THEN lower(name) ELSE slug END AS name, version, graph_kind FROM declared_dependencies WHERE name IS NOT NULL AND version IS NOT NULL AND slug IS NOT NULL)"


@query("source_specs", f"WITH {_RAW} SELECT raw, ecosystem, name, CASE WHEN graph_kind = 'complete' THEN version END AS version, CASE WHEN graph_kind <> 'complete' THEN 'github.com' END AS host, CASE WHEN graph_kind <> 'complete' THEN version END AS ref, CASE WHEN graph_kind <> 'complete' THEN 'tag' END AS ref_kind, NULL::VARCHAR AS error FROM r")
def source_specs(spark: SparkSession, d: str) -> DataFrame:
    """Sources as users write them, taken apart."""
    t = table(spark, d, "declared_dependencies").where("name IS NOT NULL AND version IS NOT NULL AND slug IS NOT NULL")
    raw = F.when(F.col("graph_kind") == "complete", F.concat(F.lower("ecosystem"), F.lit(":"), F.lower("name"), F.lit("@"), "version")).otherwise(F.concat(F.lit("github:"), "slug", F.lit("@"), "version"))
    return t.select(raw.alias("raw")).distinct().withColumn("s", K.parsed_source("raw")).select("raw", "s.*")


@query("installed_versions", "WITH d AS (SELECT slug, lower(name) AS name, version, CASE WHEN source_path LIKE '%lock%' THEN 0 WHEN source_path LIKE '%Cargo.toml' THEN 1 WHEN source_path LIKE '%package.json' THEN 2 ELSE 3 END AS priority FROM declared_dependencies WHERE version IS NOT NULL AND name IS NOT NULL AND slug IS NOT NULL) SELECT slug, name, first(version ORDER BY priority, version) AS version, min(priority) AS priority FROM d GROUP BY slug, name")
def installed_versions(spark: SparkSession, d: str) -> DataFrame:
    """The version of each package by the file that tells best."""
    path = F.col("source_path")
    priority = F.when(path.contains("lock"), 0).when(path.endswith("Cargo.toml"), 1).when(path.endswith("package.json"), 2).otherwise(3)
    t = table(spark, d, "declared_dependencies").where("version IS NOT NULL AND name IS NOT NULL AND slug IS NOT NULL").select("slug", F.lower("name").alias("name"), "version", priority.alias("p"))
    return t.groupBy("slug", "name").agg(F.min_by("version", F.struct("p", "version")).alias("version"), F.min("p").alias("priority"))


@query("canonical_reports", f"WITH {BLOBS} SELECT '{{\"blob_sha\":\"' || blob_sha || '\",\"commit_sha\":\"' || commit_sha || '\",\"end_line\":' || n || ',\"path\":\"' || path || '\",\"slug\":\"' || slug || '\",\"start_line\":' || n || '}}' AS report FROM l WHERE contains(line, 'adapter')")
def canonical_reports(spark: SparkSession, d: str) -> DataFrame:
    """Each match as canonical JSON."""
    found = search(document_blobs(table(spark, d, "documents")), plain(_ADAPTER)).matches
    return found.select(Q.canonical_json(R.IDENTITY).alias("report"))


@query("report_problems", f"WITH {BLOBS}, x AS (SELECT {COLUMNS} FROM l WHERE contains(line, 'adapter')) SELECT 'duplicate_identity' AS problem, count(*) AS n FROM x WHERE start_line % 2 = 0 HAVING count(*) > 0 UNION ALL SELECT 'bad_score', count(*) FROM x WHERE start_line % 3 = 0 HAVING count(*) > 0")
def report_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a report in which even lines stand twice and every third has a negative score."""
    report = search(document_blobs(table(spark, d, "documents")), plain(_ADAPTER))
    bad = report.matches.withColumn("score", F.when(F.col("start_line") % 3 == 0, -1.0).otherwise(F.col("score")))
    return Q.report_problems(bad.unionByName(bad.where("start_line % 2 = 0")), report.coverage)


@query("search_bounds", f"WITH {BLOBS}, x AS (SELECT count(*) AS results, count(DISTINCT path) AS candidates FROM l WHERE contains(line, 'adapter')) SELECT 'candidates' AS bound, 50::BIGINT AS \"limit\", candidates AS observed, candidates >= 50 AS reached FROM x UNION ALL SELECT 'results', 1000000, results, results >= 1000000 FROM x")
def search_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Which limits a search reached."""
    found = search(document_blobs(table(spark, d, "documents")), plain(_ADAPTER)).matches
    return Q.bounds(found.agg(F.count("*").alias("results"), F.count_distinct("path").alias("candidates")), {"results": 1_000_000, "candidates": 50})


@query("limited_results", "SELECT 100::BIGINT AS \"limit\", least(100, count(*)) AS kept, greatest(0, count(*) - 100) AS dropped FROM orders")
def limited_results(spark: SparkSession, d: str) -> DataFrame:
    """What a limit of one hundred orders costs."""
    return Q.limited(table(spark, d, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100)[1]


@query("order_violations", "WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN b = o_totalprice THEN 'duplicate' ELSE 'unsorted' END AS state FROM x WHERE b >= o_totalprice")
def order_violations(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer that cost no more than the one before."""
    return Q.out_of_order(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice"])


@query("replay_differences", "WITH a AS (SELECT DISTINCT slug, qualified_name, kind, line FROM symbol_snapshots WHERE snapshot_no = 5), b AS (SELECT DISTINCT slug, qualified_name, kind, line FROM symbol_snapshots WHERE snapshot_no = 6), x AS (SELECT slug, qualified_name, list_sort(list(coalesce(kind, '') || ':' || coalesce(CAST(line AS VARCHAR), ''))) AS v FROM a GROUP BY ALL), y AS (SELECT slug, qualified_name, list_sort(list(coalesce(kind, '') || ':' || coalesce(CAST(line AS VARCHAR), ''))) AS v FROM b GROUP BY ALL) SELECT slug, qualified_name FROM x FULL JOIN y USING (slug, qualified_name) WHERE x.v IS DISTINCT FROM y.v")
def replay_differences(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose rows differ between the last two snapshots."""
    value = F.concat(F.coalesce("kind", F.lit("")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")))
    side = lambda n: table(spark, d, "symbol_snapshots").where(f"snapshot_no = {n}").select("slug", "qualified_name", "kind", "line").distinct().groupBy("slug", "qualified_name").agg(F.array_sort(F.collect_list(value)).alias("v"))
    return Q.replays_differ(side(5), side(6), ["slug", "qualified_name"], ["v"])


@query("snapshot_roundtrip", "SELECT slug, commit_sha, count(*) AS files FROM (SELECT DISTINCT slug, commit_sha, path, content FROM verified_bytes) GROUP BY slug, commit_sha")
def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The files of each pin after an export and a checked import."""
    folder = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    Q.export_snapshot(table(spark, d, "verified_bytes"), folder)
    return Q.import_snapshot(spark, folder).groupBy("slug", "commit_sha").agg(F.count("*").alias("files"))


@query("pointer_lines", "WITH s AS (SELECT DISTINCT slug, qualified_name, path, line FROM symbol_snapshots WHERE snapshot_no = 6 AND path IS NOT NULL AND line IS NOT NULL AND qualified_name IS NOT NULL) SELECT slug, CAST(row_number() OVER (PARTITION BY slug ORDER BY path, line, qualified_name) AS INTEGER) AS position, '- [' || qualified_name || '](' || path || '#L' || line || ')' AS text FROM s")
def pointer_lines(spark: SparkSession, d: str) -> DataFrame:
    """A listing of the symbols in Markdown."""
    return Q.pointer_lines(table(spark, d, "symbol_snapshots").where("snapshot_no = 6").select("slug", "qualified_name", "path", "line").distinct())


_SAMPLE = "f AS (SELECT slug, path, size, row_number() OVER (PARTITION BY slug ORDER BY h, path) AS rn FROM (SELECT slug, path, max(octet_length(content)) AS size, sha256('s' || chr(0) || path) AS h FROM verified_bytes WHERE path IS NOT NULL AND slug IS NOT NULL AND content IS NOT NULL GROUP BY slug, path) WHERE size <= 6000)"


@query("deterministic_sample", f"WITH RECURSIVE {_SAMPLE}, w(slug, rn, total, k, path, size, took) AS (SELECT slug, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', 0::BIGINT, false FROM f WHERE rn = 1 UNION ALL SELECT f.slug, f.rn, CASE WHEN w.k < 10 AND w.total + f.size <= 6000 THEN w.total + f.size ELSE w.total END, CASE WHEN w.k < 10 AND w.total + f.size <= 6000 THEN w.k + 1 ELSE w.k END, f.path, f.size, w.k < 10 AND w.total + f.size <= 6000 FROM w JOIN f ON f.slug = w.slug AND f.rn = w.rn + 1) SELECT slug, path, size, CAST(k AS INTEGER) AS position FROM w WHERE took")
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    """Of each repository the files that fill a budget of ten files and 6,000 bytes, in the order of a hash."""
    sizes = table(spark, d, "verified_bytes").where("path IS NOT NULL AND slug IS NOT NULL AND content IS NOT NULL").groupBy("slug", "path").agg(F.max(F.octet_length("content")).alias("size"))
    return Q.deterministic_sample(sizes, ["slug"], "s", 10, 6000)


@query("duplicate_keys", "SELECT file_id, count(*) AS copies FROM verified_bytes GROUP BY file_id HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Files that were delivered more than once."""
    return duplicates(table(spark, d, "verified_bytes"), ["file_id"])


@query("duplicate_contents", "SELECT sha256(content) AS digest, count(DISTINCT file_id) AS files FROM verified_bytes WHERE content IS NOT NULL GROUP BY 1 HAVING count(DISTINCT file_id) > 1")
def duplicate_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents that several files hold."""
    t = table(spark, d, "verified_bytes").where("content IS NOT NULL").select("file_id", F.sha2("content", 256).alias("digest")).distinct()
    return t.groupBy("digest").agg(F.count("*").alias("files")).where("files > 1")


_TEXTS = "t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


@query("licence_names", r"WITH n AS (SELECT DISTINCT path FROM verified_bytes WHERE path IS NOT NULL), w AS (SELECT path, string_split_regex(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.(txt|md|rst)$', '')), '[^a-z0-9]+') AS w FROM n) SELECT path, CASE WHEN list_contains(w, 'mit') THEN 'MIT' WHEN list_contains(w, 'apache') THEN 'Apache-2.0' WHEN list_contains(w, 'bsd') THEN 'BSD-3-Clause' WHEN list_contains(w, 'mpl') THEN 'MPL-2.0' WHEN list_contains(w, 'unlicense') THEN 'Unlicense' WHEN list_contains(w, 'isc') THEN 'ISC' WHEN list_contains(w, 'zlib') THEN 'Zlib' WHEN list_contains(w, 'cc0') THEN 'CC0-1.0' END AS licence FROM w")
def licence_names(spark: SparkSession, d: str) -> DataFrame:
    """The licence that each file's name tells."""
    t = table(spark, d, "verified_bytes").where("path IS NOT NULL").select("path").distinct()
    return t.select("path", E.licence_of_name(F.col("path")).alias("licence"))


@query("routing_evidence", rf"WITH {_TEXTS} SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(gpl|agpl|lgpl|general public licen[cs]e)([^\p{{L}}\p{{N}}_]|$)') THEN 'copyleft' END, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])non-?commercial([^\p{{L}}\p{{N}}_]|$)') THEN 'noncommercial' END, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(mit|apache|bsd|isc)([^\p{{L}}\p{{N}}_]|$)') THEN 'permissive' END, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(proprietary|confidential|all rights reserved)([^\p{{L}}\p{{N}}_]|$)') THEN 'proprietary' END], lambda x: x IS NOT NULL) AS marks FROM t")
def routing_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Marks in the documents that bear on where they may go."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", E.routing_evidence(F.col("text")).alias("marks"))


@query("spdx_markers", r"WITH x AS (SELECT evidence_record_id, 'x SPDX-License-Identifier: ' || coalesce(canonical_expression, '') || chr(10) || 'SPDX-License-Identifier: MIT' || chr(10) AS t FROM license_evidence) SELECT DISTINCT evidence_record_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, 'SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]+)', 1), lambda y: trim(y)), lambda y: y <> ''))) AS markers FROM x")
def spdx_markers(spark: SparkSession, d: str) -> DataFrame:
    """The markers of recorded evidence, written out as a file would hold them."""
    text = F.concat(F.lit("x SPDX-License-Identifier: "), F.coalesce("canonical_expression", F.lit("")), F.lit("\nSPDX-License-Identifier: MIT\n"))
    return table(spark, d, "license_evidence").select("evidence_record_id", E.spdx_markers(text).alias("markers")).distinct()


@query("byte_columns", r"WITH x AS (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, line, length(line) // 2 AS c FROM x) SELECT doc_id, CAST(octet_length(encode(left(line, c))) AS INTEGER) AS byte_col, CAST(length(left(line, c)) AS INTEGER) AS char_col FROM y")
def byte_columns(spark: SparkSession, d: str) -> DataFrame:
    """The middle of each first line in bytes, and back in characters."""
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    half = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", line.alias("line"), F.floor(F.char_length(line) / 2).cast("int").alias("c"))
    placed = half.withColumn("byte_col", E.byte_column(F.col("line"), F.col("c")))
    return placed.select("doc_id", "byte_col", E.character_column(F.col("line"), F.col("byte_col")).alias("char_col"))


_DOCS = "j AS (SELECT l_orderkey, l_linenumber, '{\"documentation\":\"https://docs.invalid/' || l_partkey || '\",\"info\":{\"project_urls\":{\"Docs\":\"' || CASE WHEN l_linenumber % 2 = 0 THEN 'https' ELSE 'ftp' END || '://x.invalid/' || l_suppkey || '\"}}}' AS doc FROM lineitem)"


@query("documentation_urls", f"WITH {_DOCS} SELECT l_orderkey, l_linenumber, list_sort(list_distinct(list_filter([json_extract_string(doc, '$.documentation'), json_extract_string(doc, '$.info.project_urls.Docs')], lambda x: regexp_matches(x, '^https?://')))) AS urls FROM j")
def documentation_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of documentation in registry documents made of order lines."""
    doc = F.concat(F.lit('{"documentation":"https://docs.invalid/'), F.col("l_partkey").cast("string"), F.lit('","info":{"project_urls":{"Docs":"'), F.when(F.col("l_linenumber") % 2 == 0, "https").otherwise("ftp"), F.lit("://x.invalid/"), F.col("l_suppkey").cast("string"), F.lit('"}}}'))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.docs_urls(doc).alias("urls"))


@query("http_classes", "WITH x AS (SELECT event_id, 200 + CAST(user_id AS BIGINT) % 330 AS status, event_id % 2 AS remaining FROM events) SELECT event_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status = 429 OR (status = 403 AND remaining = 0) THEN 'rate_limited' WHEN status IN (408, 425, 500, 502, 503, 504) THEN 'retry' WHEN status IN (404, 410) THEN 'gone' WHEN status IN (401, 403) THEN 'denied' ELSE 'failed' END AS class, event_id % 100 AS wait FROM x")
def http_classes(spark: SparkSession, d: str) -> DataFrame:
    """What HTTP statuses mean for a retry, and how long to wait."""
    e = table(spark, d, "events")
    return e.select("event_id", E.http_class(200 + F.col("user_id") % 330, F.col("event_id") % 2).alias("class"), E.retry_after((F.col("event_id") % 100).cast("string"), F.current_timestamp()).alias("wait"))


@query("verified_import", "SELECT file_id, sha1(encode('blob ' || octet_length(content)) || '\\x00'::BLOB || content) AS blob_sha, octet_length(content) AS size FROM (SELECT DISTINCT file_id, content FROM verified_bytes WHERE content IS NOT NULL)")
def verified_import(spark: SparkSession, d: str) -> DataFrame:
    """Git blob SHA and size of each file's bytes."""
    return table(spark, d, "verified_bytes").where("content IS NOT NULL").select("file_id", git_blob_sha(F.col("content")).alias("blob_sha"), F.octet_length("content").cast("long").alias("size")).distinct()
