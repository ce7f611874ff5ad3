"""Queries over source files: facts, snippets, manifests, discovery and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.functions.spdx import IDS, canonical_spdx
from pinloom.operators import discovery as V
from pinloom.operators import ranking as R
from pinloom.operators import symbols as Y
from pinloom.operators.producers import produced
from pinloom.plans.queries_analysis import files
from pinloom.plans.queries_search import BLOBS, COLUMNS
from pinloom.plans.registry import query
from pinloom.plans.search import run_benchmark, search_lines
from pinloom.plans.sizing import shared_folder
from pinloom.plans.spec import Predicate, SearchSpec, required_capabilities
from pinloom.sources.blobs import document_blobs, line_rows
from pinloom.sources.manifests import bills_of_materials, dependency_edges
from pinloom.sources.tables import table
from pinloom.streaming.search import read_matches, run_available, stream_matches


@query("python_facts")
def python_facts(spark: SparkSession, d: str) -> DataFrame:
    """Definitions, references, calls, imports and signatures of the Python files."""
    return Y.fact_table(files(spark, d)).where("kind NOT LIKE 'edge:%'")


@query("python_edges")
def python_edges(spark: SparkSession, d: str) -> DataFrame:
    """The static graph edges of the Python files."""
    facts = Y.fact_table(files(spark, d)).where("kind LIKE 'edge:%'")
    return facts.select("slug", "path", F.substring("kind", 6, 100).alias("kind"), F.col("detail").alias("src"), F.col("value").alias("dst"), "line")


@query("source_edges")
def source_edges(spark: SparkSession, d: str) -> DataFrame:
    """The symbols, edges and unresolved references of all source files, by the producer of each language."""
    return produced(files(spark, d))


@query("adapter_agreement")
def adapter_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far syntax and pattern agree on the lines that define functions and classes, per repository."""
    py = files(spark, d).where("path LIKE '%.py'")
    syntax = Y.fact_table(py).where("kind = 'signature'").select("slug", "path", "line", F.lit(1).alias("a")).distinct()
    text = py.select("slug", "path", F.posexplode(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n", -1)).alias("i", "t"))
    pattern = text.where(F.col("t").rlike(r"^\s*(?:async\s+)?def\s+\w+")).select("slug", "path", (F.col("i") + 1).alias("line"), F.lit(1).alias("b"))
    both = syntax.join(pattern, ["slug", "path", "line"], "full_outer").groupBy("slug").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("agree"), F.count("*").alias("all"), F.count("a").alias("syntax"), F.count("b").alias("pattern"))
    return both.select("slug", "agree", "syntax", "pattern", F.round(F.col("agree") / F.col("all"), 6).alias("agreement"))



def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Fenced blocks of the documents, and source documents as a whole."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("path", F.lit("unknown.md")).alias("path"), "text", "doc_kind")
    fenced = docs.where(F.col("text").contains("```")).select("doc_id", "path", F.inline(Y.fenced_snippets(F.col("text"))))
    whole = docs.where("doc_kind = 'source' AND trim(text) <> ''").select("doc_id", "path", F.lit(1).alias("line"), F.lit("").alias("language"), F.col("text").alias("code"))
    return fenced.unionByName(whole)


_FENCED = r"""WITH d AS (SELECT doc_id, coalesce(path, 'unknown.md') AS path, text, doc_kind FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, path, CASE WHEN text = '' THEN [] WHEN right(text, 1) = chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM d WHERE contains(text, '```')),
m AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '^[ ]{0,3}```')) AS marks FROM x), p AS (SELECT doc_id, path, ls, marks, unnest(range(1, len(marks) // 2 + 1)) AS k FROM m),
c AS (SELECT doc_id, path, CAST(marks[2 * k - 1] + 1 AS INTEGER) AS line, lower(regexp_extract(ls[marks[2 * k - 1]], '```\s*([\w+#.-]*)', 1)) AS language, array_to_string(ls[marks[2 * k - 1] + 1 : marks[2 * k] - 1], chr(10)) AS code FROM p)
SELECT * FROM c WHERE trim(code) <> '' UNION ALL SELECT doc_id, path, 1, '', text FROM d WHERE doc_kind = 'source' AND trim(text) <> ''"""


@query("fenced_snippets", _FENCED)
def fenced_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The fenced code blocks of the documents."""
    return snippets(spark, d)


@query("example_ranking")
def example_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The ten examples that mention most of the functions that the pinned files call, with what they show."""
    code = snippets(spark, d).withColumn("id", F.concat_ws(":", "doc_id", "line"))
    symbols = Y.fact_table(files(spark, d)).where("kind = 'call'").select(F.col("value").alias("symbol")).distinct()
    found = code.join(Y.mentioned(code, ["id"], "code", symbols), "id")
    best = found.orderBy(F.size("symbols").desc(), "path", "line", F.length("code").desc(), "id").limit(10)
    return best.select("doc_id", "path", "line", "symbols", Y.example_labels(F.col("path"), F.col("code"), F.col("symbols")).alias("labels"))


@query("manifest_dependencies")
def manifest_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """The dependency edges in the manifests of the pinned files."""
    return dependency_edges(files(spark, d))


@query("bills_of_materials")
def bills(spark: SparkSession, d: str) -> DataFrame:
    """A bill of materials for each pin."""
    return bills_of_materials(dependency_edges(files(spark, d)))


_IDS = "i AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in IDS) + "]) AS id)"


@query("spdx_expressions", f"WITH {_IDS}, e AS (SELECT DISTINCT canonical_expression AS x FROM license_evidence), p AS (SELECT x, unnest(string_split(x, ' OR ')) AS part, generate_subscripts(string_split(x, ' OR '), 1) AS n FROM e WHERE x IS NOT NULL), m AS (SELECT x, count(*) AS k, count(id) AS found, string_agg(id, ' OR ' ORDER BY n) AS s FROM p LEFT JOIN i ON lower(i.id) = lower(trim(part)) GROUP BY x) SELECT e.x AS canonical_expression, CASE WHEN k = found THEN s END AS spdx FROM e LEFT JOIN m ON e.x = m.x")
def spdx_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Recorded expressions in canonical form, null where they are none."""
    t = table(spark, d, "license_evidence").select("canonical_expression").distinct()
    return t.select("canonical_expression", canonical_spdx("canonical_expression").alias("spdx"))


#: All recorded hits here have the bytes they claim, so the first member of each group is verified by one attempt.
_GROUPS = f"""WITH {BLOBS}, k AS (SELECT slug, commit_sha, path, min(blob_sha) AS blob_sha FROM b GROUP BY ALL), m AS (SELECT slug, path, min(struct_pack(slug := slug, commit_sha := commit_sha, path := path, blob_sha := blob_sha)) AS h FROM k GROUP BY slug, path), u AS (SELECT h.blob_sha AS blob_sha, min(h) AS h FROM m GROUP BY 1), z AS (SELECT h.slug AS slug, h.commit_sha AS commit_sha, h.path AS path, h.blob_sha AS blob_sha, row_number() OVER (ORDER BY h) AS rn FROM u)"""


@query("verified_candidates", _GROUPS + " SELECT slug, commit_sha, path, blob_sha, 1::BIGINT AS attempts, CASE WHEN rn <= 500 THEN 'verified' ELSE 'not_attempted' END AS state FROM z")
def verified_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Recorded hits verified by their bytes, with promotion within a group and a budget of attempts."""
    blobs = document_blobs(table(spark, d, "documents"))
    return V.verified_candidates(blobs.select(*V.IDENTITY), blobs, 500)


@query("global_search", _GROUPS + f" SELECT {COLUMNS}, 1.0::DOUBLE AS score, ['exact_text'] AS matched_kinds FROM l WHERE contains(line, 'adapter') AND (slug, commit_sha, path, blob_sha) IN (SELECT (slug, commit_sha, path, blob_sha) FROM z WHERE rn <= 500)")
def global_search(spark: SparkSession, d: str) -> DataFrame:
    """A query over the verified candidates of recorded hits."""
    blobs = document_blobs(table(spark, d, "documents"))
    return V.global_search(blobs.select(*V.IDENTITY), blobs, SearchSpec((Predicate("exact_text", "adapter"),), mode="global_discovery"), 500)


@query("merged_matches", f"WITH {BLOBS}, m AS (SELECT {COLUMNS}, 1.0 AS score, ['exact_text'] AS k FROM l WHERE contains(line, 'adapter') UNION ALL SELECT {COLUMNS}, 3.0, ['call'] FROM l WHERE contains(line, 'adapter') AND n % 2 = 0) SELECT slug, commit_sha, path, blob_sha, start_line, end_line, CAST(max(score) AS DOUBLE) AS score, list_sort(list_distinct(flatten(list(k)))) AS matched_kinds FROM m GROUP BY ALL".replace(" GROUP BY ALL", " GROUP BY slug, commit_sha, path, blob_sha, start_line, end_line"))
def merged_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of several batches, one for each identity with the union of kinds."""
    from pinloom.plans.search import search

    found = search(document_blobs(table(spark, d, "documents")), SearchSpec((Predicate("exact_text", "adapter"),))).matches
    other = found.where("start_line % 2 = 0").withColumn("score", F.lit(3.0)).withColumn("matched_kinds", F.array(F.lit("call")))
    return R.merged_matches(found.unionByName(other))


@query("streaming_search", f"WITH {BLOBS} SELECT DISTINCT {COLUMNS}, 1.0::DOUBLE AS score, ['exact_text'] AS matched_kinds FROM l WHERE contains(line, 'adapter')")
def streaming_search(spark: SparkSession, d: str) -> DataFrame:
    """The scoped search over the documents as a stream, run until all that is there is read."""
    schema = table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    blobs = document_blobs(stream)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run_available(stream_matches(blobs, SearchSpec((Predicate("exact_text", "adapter"),))), f"{folder}/out", f"{folder}/state")
    return read_matches(spark, f"{folder}/out")


@query("line_search", f"WITH {BLOBS}, x AS (SELECT path AS p FROM l WHERE path NOT LIKE '%.js' GROUP BY path HAVING bool_or(contains(line, 'cache'))) SELECT {COLUMNS}, 1.0::DOUBLE AS score, ['exact_text'] AS matched_kinds FROM l WHERE contains(line, 'adapter') AND path NOT LIKE '%.js' AND path NOT IN (SELECT p FROM x)")
def line_search(spark: SparkSession, d: str) -> DataFrame:
    """A search over rows of lines, as blobs too large for one row arrive, in languages whose text needs no mask."""
    lines = line_rows(document_blobs(table(spark, d, "documents")))
    return search_lines(lines, SearchSpec((Predicate("exact_text", "adapter"),), must_not=(Predicate("exact_text", "cache"),)))


@query("benchmark_run", f"""WITH {BLOBS}, t AS (SELECT 'adapter' AS task, {COLUMNS} FROM l WHERE contains(line, 'optional adapter') UNION ALL SELECT 'ledger', {COLUMNS} FROM l WHERE contains(line, 'optional ledger')),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY slug, commit_sha, path, blob_sha, start_line, end_line) AS rank FROM t) SELECT task, slug, commit_sha, path, blob_sha, start_line, end_line, rank FROM r WHERE rank <= 10""")
def benchmark_run(spark: SparkSession, d: str) -> DataFrame:
    """The first ten results of each task of a benchmark, whose queries are known by their digests."""
    blobs = document_blobs(table(spark, d, "documents"))
    tasks = {name: SearchSpec((Predicate("exact_text", f"optional {name}"),)) for name in ("adapter", "ledger")}
    return run_benchmark(blobs, [(name, spec, spec.digest()) for name, spec in tasks.items()])


@query("capability_compilation", "SELECT * FROM (VALUES ('must', 'exact_text', true), ('must', 'identifier', true), ('must', 'regex', false), ('must_not', 'exact_text', false), ('should', 'identifier', true)) AS t(clause, kind, supported)")
def capability_compilation(spark: SparkSession, d: str) -> DataFrame:
    """What a query asks of an index, and whether one that knows texts and words can do it."""
    word = Predicate("identifier", "ledger")
    spec = SearchSpec((Predicate("exact_text", "a"), word, Predicate("regex", "x+")), should=(word,), must_not=(Predicate("exact_text", "b"),))
    port = {("must", "exact_text"), ("must", "identifier"), ("should", "identifier")}
    return spark.createDataFrame([(*c, c in port) for c in required_capabilities(spec)], "clause string, kind string, supported boolean")
