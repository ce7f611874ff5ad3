"""Search queries over the documents as blobs, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.operators import ranking as R
from pinloom.operators import trigram as T
from pinloom.plans.registry import query
from pinloom.plans.search import search
from pinloom.plans.sizing import shared_folder
from pinloom.plans.spec import Predicate, SearchSpec, translation
from pinloom.sources.blobs import document_blobs, file_blobs, line_rows
from pinloom.sources.tables import table

#: Comments and strings of JavaScript, whose lines are searched without them.
_MASKED = r"""list_transform(regexp_extract_all(text, '//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"(?:[^"\\]|\\(?s:.))*(?:"|\\?\z)|''(?:[^''\\]|\\(?s:.))*(?:''|\\?\z)|`(?:[^`\\]|\\(?s:.))*(?:`|\\?\z)|[^/"''`]+|/'),
  lambda x: CASE WHEN x[1] IN (chr(34), chr(39), chr(96)) OR x[1:2] IN ('//', '/*') THEN regexp_replace(x, '[^\n]', ' ', 'g') ELSE x END)"""
#: The lines of texts t of some rows.
_LINES = "CASE WHEN t = '' THEN [] WHEN right(t, 1) = chr(10) THEN string_split(t, chr(10))[:-2] ELSE string_split(t, chr(10)) END"
#: The documents as blobs (b), those with an adapter with the text it sees (f), and their lines (l).
BLOBS = rf"""
b AS (SELECT source AS slug, sha1(source) AS commit_sha, text, octet_length(encode(text)) AS size,
  coalesce(lang, 'none') || '/' || doc_id || CASE lower(trim(lang)) WHEN 'en' THEN '.py' WHEN 'python' THEN '.py' WHEN 'fr' THEN '.rs' WHEN 'rust' THEN '.rs' WHEN 'de' THEN '.go' WHEN 'go' THEN '.go' WHEN 'javascript' THEN '.js' ELSE '.txt' END AS path,
  sha1(encode('blob ' || octet_length(encode(text))) || '\x00'::BLOB || encode(text)) AS blob_sha FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
f0 AS (SELECT *, CASE WHEN path LIKE '%.js' THEN array_to_string({_MASKED}, '') ELSE text END AS t FROM b WHERE regexp_matches(path, '\.(py|rs|go|js)$')),
f AS (SELECT *, {_LINES} AS ls FROM f0),
l AS (SELECT slug, commit_sha, path, blob_sha, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM f)
""".strip()
COLUMNS = "slug, commit_sha, path, blob_sha, CAST(n AS INTEGER) AS start_line, CAST(n AS INTEGER) AS end_line"


def word(text: str, line: str = "line") -> str:
    return rf"regexp_matches({line}, '(^|[^\p{{L}}\p{{N}}_]){text}([^\p{{L}}\p{{N}}_]|$)')"


def plain(*predicates: Predicate, **more) -> SearchSpec:
    return SearchSpec(tuple(predicates), **more)


def _search(name: str, spec: SearchSpec, where: str, score: str, kinds: str, with_sql: str = "") -> None:
    sql = f"WITH {BLOBS}{with_sql} SELECT {COLUMNS}, CAST({score} AS DOUBLE) AS score, {kinds} AS matched_kinds FROM l WHERE {where}"

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search(document_blobs(table(spark, d, "documents")), spec).matches


_LEDGER, _ADAPTER, _CACHE = Predicate("identifier", "ledger"), Predicate("exact_text", "adapter"), Predicate("exact_text", "cache")
_RELEASE = Predicate("regex", r"^In release \d+\.\d+ the (\w+) [a-z]+ moved")
_search("scoped_exact_text", plain(_ADAPTER), "contains(line, 'adapter')", "1", "['exact_text']")
_search("scoped_identifier", plain(_LEDGER), word("ledger"), "1", "['identifier']")
_search("scoped_regex", plain(_RELEASE), r"regexp_matches(line, '^In release \d+\.\d+ the ([\p{L}\p{N}_]+) [a-z]+ moved')", "1", "['regex']")
_search("token_sequence", plain(Predicate("token_sequence", "returns the  optional")), r"regexp_matches(line, '(^|[^\p{L}\p{N}_])returns[ \t\n\r\f\v]+the[ \t\n\r\f\v]+optional([^\p{L}\p{N}_]|$)')", "1", "['token_sequence']")
_DEF = r"((path LIKE '%.py' AND regexp_matches(line, '^\s*((async\s+)?(def|class)\s+acc([^\p{L}\p{N}_]|$)|acc\s*[:=])')) OR (path LIKE '%.rs' AND regexp_matches(line, '^\s*(pub(\([^)]*\))?\s+)?((async\s+)?(unsafe\s+)?(fn|struct|enum|trait|type|mod)|const|static)\s+acc([^\p{L}\p{N}_]|$)')) OR (path LIKE '%.go' AND regexp_matches(line, '^\s*(func\s+(\([^)]*\)\s+)?|type\s+|(const|var)\s+)acc([^\p{L}\p{N}_]|$)')) OR (path LIKE '%.js' AND regexp_matches(line, '^\s*(export\s+)?(default\s+)?((async\s+)?function|class)\s+acc([^\p{L}\p{N}_$]|\$+([^\p{L}\p{N}_$]|$)|$)|^\s*(export\s+)?(declare\s+)?(const|let|var)\s+acc\s*(:[^=]+)?=|^\s*((public|protected|private|static|abstract|override|readonly|async|get|set)\s+)*acc\s*\([^\r\n{};]*\)(\s*:\s*[^={;]+)?\s*\{')))"
_search("symbol_definition", plain(Predicate("symbol_definition", "acc")), _DEF, "1", "['symbol_definition']")
_search("symbol_reference", plain(Predicate("symbol_reference", "acc")), rf"(CASE WHEN path LIKE '%.js' THEN regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_$])acc([^\p{{L}}\p{{N}}_$]|$)') ELSE {word('acc')} END) AND NOT {_DEF}", "1", "['symbol_reference']")
_search("call_predicate", plain(Predicate("call", "len")), r"regexp_matches(line, '(^|[^\p{L}\p{N}_])len\s*(\(|<)') AND (path LIKE '%.rs' OR regexp_matches(line, '(^|[^\p{L}\p{N}_])len\s*\(')) AND (path NOT LIKE '%.js' OR regexp_matches(line, '(^|[^\p{L}\p{N}_$])len\s*\('))", "1", "['call']")
_search("signature_predicate", plain(Predicate("signature", r"\w+\(\w+, \w+=\d+\)")), r"regexp_matches(line, '[\p{L}\p{N}_]+\([\p{L}\p{N}_]+, [\p{L}\p{N}_]+=\d+\)') AND ((path LIKE '%.py' AND (contains(line, 'def ') OR contains(line, 'class '))) OR (path LIKE '%.rs' AND (contains(line, 'fn ') OR contains(line, 'struct ') OR contains(line, 'trait '))) OR (path LIKE '%.go' AND (contains(line, 'func') OR contains(line, 'type'))) OR (path LIKE '%.js' AND regexp_matches(line, '^\s*(export\s+)?(default\s+)?((async\s+)?function|class)\s+[A-Za-z_$]|^\s*(export\s+)?(declare\s+)?(const|let|var)\s+[A-Za-z_$][\p{L}\p{N}_$]*\s*(:[^=]+)?=|^\s*((public|protected|private|static|abstract|override|readonly|async|get|set)\s+)*[A-Za-z_$][\p{L}\p{N}_$]*\s*\([^\r\n{};]*\)(\s*:\s*[^={;]+)?\s*\{')))", "1", "['signature']")
_search("must_and_line", plain(_ADAPTER, _LEDGER), f"contains(line, 'adapter') AND {word('ledger')}", "2", "['exact_text', 'identifier']")
_FILES = ", s AS (SELECT path AS p, bool_or(contains(line, 'adapter')) AS a, bool_or(contains(line, 'cache')) AS c, bool_or({w}) AS w FROM l GROUP BY path)".replace("{w}", word("ledger"))
_search("must_and_wholefile", plain(_ADAPTER, _LEDGER, whole_file_must=True), f"path IN (SELECT p FROM s WHERE a AND w) AND (contains(line, 'adapter') OR {word('ledger')})", "2", f"list_filter([CASE WHEN contains(line, 'adapter') THEN 'exact_text' END, CASE WHEN {word('ledger')} THEN 'identifier' END], lambda x: x IS NOT NULL)", _FILES)
_search("must_not_doc", plain(_ADAPTER, must_not=(_CACHE,)), "contains(line, 'adapter') AND path IN (SELECT p FROM s WHERE NOT c)", "1", "['exact_text']", _FILES)
_search("should_boost_line", plain(_ADAPTER, should=(_LEDGER, _CACHE)), "contains(line, 'adapter')", f"1 + CASE WHEN {word('ledger')} AND contains(line, 'cache') THEN 2 ELSE 0 END", f"CASE WHEN {word('ledger')} AND contains(line, 'cache') THEN ['exact_text', 'identifier'] ELSE ['exact_text'] END")
_search("should_boost_file", plain(_ADAPTER, should=(_LEDGER, _CACHE), whole_file_must=True), "contains(line, 'adapter')", "1 + (SELECT CAST(w AS INTEGER) + CAST(c AS INTEGER) FROM s WHERE p = path)", "CASE WHEN (SELECT w FROM s WHERE p = path) THEN ['exact_text', 'identifier'] ELSE ['exact_text'] END", _FILES)
_search("path_filter", plain(_ADAPTER, Predicate("path", "fr/"), Predicate("path", r"^en/\d*7\.py$")), r"contains(line, 'adapter') AND (contains(path, 'fr/') OR regexp_matches(path, '^en/\d*7\.py$'))", "1", "['exact_text']")
_search("path_only_should", plain(Predicate("path", "en/1"), should=(_ADAPTER,)), "contains(line, 'adapter') AND contains(path, 'en/1')", "1", "['exact_text']")
_search("language_required", plain(Predicate("exact_text", "adapter", "Py")), "contains(line, 'adapter') AND path LIKE '%.py'", "1", "['exact_text']")


#: Pinned files as blobs; of their bytes those above 127 are no part of the words looked for.
_FILES_SQL = rf"""
g AS (SELECT slug, commit_sha, path, min(content) AS c FROM verified_bytes GROUP BY slug, commit_sha, path),
b AS (SELECT slug, commit_sha, path, sha1(encode('blob ' || octet_length(c)) || '\x00'::BLOB || c) AS blob_sha,
  array_to_string(list_transform(regexp_extract_all(hex(c), '(?:[0-9A-F]{{2}})'), lambda h: CASE WHEN h < '80' THEN chr(CAST('0x' || h AS INTEGER)) ELSE '?' END), '') AS text FROM g WHERE regexp_matches(path, '\.(py|rs|go|js)$') AND c IS NOT NULL),
f0 AS (SELECT *, CASE WHEN path LIKE '%.js' THEN array_to_string({_MASKED}, '') ELSE text END AS t FROM b),
f AS (SELECT *, {_LINES} AS ls FROM f0),
l AS (SELECT slug, commit_sha, path, blob_sha, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM f)
""".strip()


def _file_search(name: str, spec: SearchSpec, where: str, kind: str) -> None:
    @query(name, f"WITH {_FILES_SQL} SELECT {COLUMNS}, 1.0::DOUBLE AS score, ['{kind}'] AS matched_kinds FROM l WHERE {where}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search(file_blobs(table(spark, d, "verified_bytes")), spec).matches


_file_search("import_predicate", plain(Predicate("import", "rank")), r"contains(line, 'rank') AND ((path LIKE '%.py' AND regexp_matches(line, '^\s*(import |from )')) OR (path LIKE '%.rs' AND regexp_matches(line, '^\s*use ')) OR (path LIKE '%.go' AND (contains(line, 'import') OR contains(line, chr(9) || chr(34)))) OR (path LIKE '%.js' AND regexp_matches(line, '^\s*import($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])require\s*\(')))", "import")
_file_search("masked_import", plain(Predicate("import", "Rank", "js")), r"path LIKE '%.js' AND contains(line, 'Rank') AND regexp_matches(line, '^\s*import($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])require\s*\(')", "import")
_file_search("masked_call", plain(Predicate("call", "map", "js")), r"path LIKE '%.js' AND regexp_matches(line, '(^|[^\p{L}\p{N}_$])map\s*\(')", "call")
_file_search("masked_text", plain(Predicate("exact_text", "store.", "javascript")), "path LIKE '%.js' AND contains(line, 'store.')", "exact_text")


@query("python_regex_fallback")
def python_regex_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A pattern that only Python can run: a named group and a reference back to it."""
    return search(document_blobs(table(spark, d, "documents")), plain(Predicate("regex", r"(?P<w>\b\w{6,}\b).*\b(?P=w)\b"))).matches


@query("masked_identifier", f"WITH {BLOBS} SELECT {COLUMNS}, 1.0::DOUBLE AS score, ['identifier'] AS matched_kinds FROM l WHERE path LIKE '%.js' AND {word('acc')}")
def masked_identifier(spark: SparkSession, d: str) -> DataFrame:
    """A search in a language whose comments and strings don't count."""
    return search(document_blobs(table(spark, d, "documents")), plain(Predicate("identifier", "acc", "js"))).matches


@query("coverage_report", f"WITH {BLOBS} SELECT count(*) AS files_eligible, count(*) AS files_indexed, 0::BIGINT AS files_excluded, 'complete_for_declared_universe' AS status FROM b WHERE regexp_matches(path, '\\.(py|rs|go|js)$') AND (contains(path, 'en/') OR contains(path, 'javascript/'))")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """What was and was not searched."""
    spec = plain(_ADAPTER, Predicate("path", "en/"), Predicate("path", "javascript/"))
    return search(document_blobs(table(spark, d, "documents")), spec).coverage.drop("exclusions")


_RANKED = f"""WITH {BLOBS}, m AS (SELECT {COLUMNS}, CAST(1 + CASE WHEN {word('ledger')} AND contains(line, 'cache') THEN 2 ELSE 0 END AS DOUBLE) AS score FROM l WHERE contains(line, 'adapter')),
x AS (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi, row_number() OVER (ORDER BY score DESC, slug, commit_sha, path, blob_sha, start_line, end_line) AS rank, count(*) OVER () AS total FROM m)
SELECT slug, commit_sha, path, blob_sha, start_line, end_line, score, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS normalized_score, rank, total - rank + 1 AS rank_score FROM x"""


@query("ranked_matches", _RANKED)
def ranked_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches in their total order with ranks."""
    report = search(document_blobs(table(spark, d, "documents")), plain(_ADAPTER, should=(_LEDGER, _CACHE)))
    return R.ranked_matches(report.matches).drop("matched_kinds").withColumn("rank", F.col("rank").cast("long"))


@query("match_dedup", f"WITH {BLOBS}, m AS (SELECT {COLUMNS}, 1.0::DOUBLE AS score, ['exact_text'] AS matched_kinds FROM l WHERE contains(line, 'adapter') UNION ALL SELECT {COLUMNS}, 2.0, ['exact_text', 'identifier'] FROM l WHERE contains(line, 'adapter') AND {word('ledger')}), r AS (SELECT *, row_number() OVER (PARTITION BY slug, commit_sha, path, blob_sha, start_line, end_line ORDER BY score DESC, matched_kinds DESC) AS rn FROM m) SELECT * EXCLUDE (rn) FROM r WHERE rn = 1")
def match_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The matches of two searches, each identity once with its best score."""
    blobs = document_blobs(table(spark, d, "documents"))
    return R.dedup_matches(search(blobs, plain(_ADAPTER)).matches.unionByName(search(blobs, plain(_ADAPTER, _LEDGER)).matches))


@query("must_not_line", f"WITH {BLOBS} SELECT {COLUMNS}, 1.0::DOUBLE AS score, ['exact_text'] AS matched_kinds FROM l WHERE contains(line, 'adapter') AND NOT contains(line, 'cache')")
def must_not_line(spark: SparkSession, d: str) -> DataFrame:
    """Matches without the lines that another predicate hits: the line-level exclusion of a verified hit."""
    return search(document_blobs(table(spark, d, "documents")), plain(_ADAPTER, must_not=(_CACHE,), must_not_lines=True)).matches


_GRAMS = f"WITH {BLOBS}, g AS (SELECT DISTINCT path, lower(hex(encode(text)[i:i + 2])) AS gram FROM b, range(1, 200000) AS t(i) WHERE i <= size - 2)"


@query("trigram_postings", _GRAMS.replace("200000", "100000") + " SELECT gram, count(*) AS blobs FROM g GROUP BY gram")
def trigram_postings(spark: SparkSession, d: str) -> DataFrame:
    """In how many blobs each three bytes occur."""
    return T.postings(document_blobs(table(spark, d, "documents")))


_NEEDLE = Predicate("exact_text", "optional adapter")


@query("trigram_candidates", f"WITH {BLOBS} SELECT slug, commit_sha, path, blob_sha FROM b WHERE " + " AND ".join(f"contains(text, '{'optional adapter'[i : i + 3]}')" for i in range(14)))
def trigram_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The blobs that hold all grams of the needle."""
    blobs = document_blobs(table(spark, d, "documents"))
    return T.candidates(T.index(blobs), plain(_NEEDLE))


@query("index_equals_scan", f"WITH {BLOBS} SELECT {COLUMNS}, 1.0::DOUBLE AS score, ['exact_text'] AS matched_kinds FROM l WHERE contains(line, 'optional adapter')")
def index_equals_scan(spark: SparkSession, d: str) -> DataFrame:
    """A search through the index, which must give what the scan gives."""
    return T.indexed_search(document_blobs(table(spark, d, "documents")), stored_index(spark, d), plain(_NEEDLE)).matches


_STORED: dict[tuple[str, str], T.StoredIndex] = {}


def stored_index(spark: SparkSession, d: str) -> T.StoredIndex:
    """The written index of the documents; written, opened and checked once in a session."""
    blobs, place = document_blobs(table(spark, d, "documents")), (spark.sparkContext.applicationId, d)
    if place not in _STORED:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        T.write_index(blobs, folder)
        _STORED[place] = T.open_index(spark, folder)
    return _STORED[place]


@query("index_manifest", f"WITH {BLOBS}, u AS (SELECT DISTINCT slug, commit_sha, path, blob_sha, size, text FROM b), g AS (SELECT DISTINCT slug, path, encode(text)[i:i + 2] AS gram FROM u, range(1, 200000) AS t(i) WHERE i <= size - 2) SELECT (SELECT count(*) FROM u) AS documents, (SELECT count(*) FROM g) AS postings, 'trigrams-1' AS version")
def index_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the written index holds, after it was opened and checked against the documents."""
    index = T.open_index(spark, stored_index(spark, d).folder, document_blobs(table(spark, d, "documents")))
    return index.documents.agg(F.count("*").alias("documents")).join(F.broadcast(index.postings.agg(F.count("*").alias("postings")))).withColumn("version", F.lit(index.manifest["version"]))


@query("blob_lines", f"WITH {BLOBS}, w AS (SELECT *, {_LINES.replace('t = ', 'text = ').replace('(t,', '(text,')} AS ws FROM b) SELECT slug, commit_sha, path, blob_sha, unnest(ws) AS line, CAST(generate_subscripts(ws, 1) AS INTEGER) AS line_no FROM w")
def blob_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the blobs."""
    return line_rows(document_blobs(table(spark, d, "documents")))


@query("permalinks", f"WITH {BLOBS} SELECT 'https://host.invalid/' || slug || '/blob/' || commit_sha || '/' || path || '#L' || n AS permalink FROM l WHERE contains(line, 'optional adapter')")
def permalinks(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the matches."""
    found = search(document_blobs(table(spark, d, "documents")), plain(_NEEDLE)).matches
    return found.select(F.format_string("https://host.invalid/%s/blob/%s/%s#L%d", "slug", "commit_sha", "path", "start_line").alias("permalink"))


@query("query_translation", "SELECT * FROM (VALUES ('must', 0, 'identifier', 'query', 'ledger'), ('must', 1, 'path', 'superset_local_filter', 'path:src'), ('should', 0, 'exact_text', 'local_filter', NULL), ('must_not', 0, 'exact_text', 'local_filter', NULL)) AS t(clause, predicate_index, kind, strategy, emitted)")
def query_translation(spark: SparkSession, d: str) -> DataFrame:
    """What a remote index gets of a query, and what is filtered here."""
    _, rows = translation(plain(_LEDGER, Predicate("path", "src"), should=(_ADAPTER,), must_not=(_CACHE,)))
    return spark.createDataFrame(rows, "clause string, predicate_index int, kind string, strategy string, emitted string")


