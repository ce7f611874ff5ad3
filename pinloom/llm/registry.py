"""The registered queries over training data, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.llm import foreign, functions, leakage, licenses, packing, parsing, spans, splitting
from pinloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that gives the same rows where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_SHARED_SQL = """
WITH f AS (SELECT DISTINCT file_id, content FROM verified_bytes WHERE content IS NOT NULL),
h AS (SELECT file_id, regexp_extract_all(hex(content), '(?:[0-9A-F]{2})') AS bytes FROM f),
p AS (SELECT file_id, array_to_string(list_transform(bytes, lambda b: CASE WHEN b = '0A' THEN chr(10) ELSE b END), '') AS t FROM h),
s AS (SELECT file_id, string_split(t, chr(10)) AS ls FROM p),
q AS (SELECT file_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM s),
w AS (SELECT file_id, unnest(range(1, len(ls) - 10)) AS k0, ls FROM q WHERE len(ls) >= 12),
v AS (SELECT file_id, k0, md5(array_to_string(ls[k0:k0 + 11], chr(10))) AS k FROM w),
r AS (SELECT k FROM v GROUP BY k HAVING count(DISTINCT file_id) > 1),
n AS (SELECT DISTINCT file_id, k0 + i AS line FROM v JOIN r USING (k), range(0, 12) AS t(i)),
g AS (SELECT file_id, line, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS island FROM n)
SELECT file_id, CAST(min(line) AS INTEGER) AS start_line, CAST(max(line) AS INTEGER) AS end_line FROM g GROUP BY file_id, island
""".strip()


@query("p1_found", _SHARED_SQL)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The line blocks of every file that occur verbatim in another one."""
    return spans.shared_spans(table(spark, d, "verified_bytes")).select("file_id", "start_line", "end_line")


_LINES_SQL = "z AS (SELECT file_id, CAST(len(ls) AS INTEGER) AS lines FROM q), y AS (SELECT file_id, island, count(*) AS k FROM g GROUP BY ALL), o AS (SELECT file_id, CAST(sum(k) AS INTEGER) AS shared_lines, CAST(count(*) AS INTEGER) AS blocks FROM y GROUP BY file_id)"


@query("p1_shares", _SHARED_SQL[: _SHARED_SQL.rindex("SELECT file_id")].rstrip() + f", {_LINES_SQL} SELECT file_id, lines, coalesce(shared_lines, 0) AS shared_lines, coalesce(blocks, 0) AS blocks, round(CASE WHEN lines > 0 THEN coalesce(shared_lines, 0) / lines ELSE 0.0 END, 6) AS shared_part FROM z LEFT JOIN o USING (file_id)")
def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each file is shared: its lines, the shared ones, and their part."""
    files = table(spark, d, "verified_bytes").where("content IS NOT NULL").select("file_id", "content").distinct()
    text = F.expr("decode(content, 'ISO-8859-1')")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    sizes = files.select("file_id", (breaks + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)).cast("int").alias("lines"))
    shared = spans.shared_spans(table(spark, d, "verified_bytes")).groupBy("file_id").agg(F.max("shared_lines").alias("shared_lines"), F.count("*").cast("int").alias("blocks"))
    return sizes.join(shared, "file_id", "left").select(
        "file_id", "lines", F.coalesce("shared_lines", F.lit(0)).alias("shared_lines"), F.coalesce("blocks", F.lit(0)).alias("blocks"),
        F.round(F.coalesce(F.col("shared_lines") / F.col("lines"), F.lit(0.0)), 6).alias("shared_part"),
    )


@query("p8_assignment")
def p8_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every text's container."""
    return packing.pack_texts(table(spark, d, "documents"))


@query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The containers, their items and unused space."""
    return packing.containers(packing.pack_texts(table(spark, d, "documents")))


@query("p8_invariants", "SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS tokens, CAST(greatest(1, ceil(coalesce(octet_length(encode(text)), 0) / 8192)) AS BIGINT) AS pieces, true AS whole FROM documents")
def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of every text, by the byte tokenizer: its tokens, all of them assigned once, and that only texts above the capacity are split."""
    p = packing.pack_texts(table(spark, d, "documents"), tokenizer="byt5")
    return p.groupBy("doc_id").agg(F.sum("n_tokens").cast("long").alias("tokens"), F.count("*").alias("pieces"), (F.sum("n_tokens") == F.max(F.col("start_token") + F.col("n_tokens"))).alias("whole"))


@query("p8_fill", "SELECT true AS within_capacity, true AS little_unused")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Whether no container is over its capacity, and all together are filled to 98 percent or lack less than one container for each shard."""
    c = packing.containers(packing.pack_texts(table(spark, d, "documents")))
    shards = F.count_distinct(F.shiftright("container_id", packing.SHARD_SHIFT))
    return c.agg(F.max("filled").alias("m"), F.sum("filled").alias("f"), F.count("*").alias("n"), shards.alias("s")).select((F.col("m") <= packing.CAPACITY).alias("within_capacity"), ((F.col("f") >= 0.98 * packing.CAPACITY * F.col("n")) | (F.col("n") - F.ceil(F.col("f") / packing.CAPACITY) <= 2 * F.col("s"))).alias("little_unused"))


_LEAK_SQL = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS ws FROM documents),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS ws FROM eval_items),
ip AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 11), lambda k: array_to_string(ws[k:k + 12], ' '))) AS g FROM i WHERE len(ws) >= 13),
dp AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda k: array_to_string(ws[k:k + 12], ' '))) AS g FROM d WHERE len(ws) >= 13),
s AS (SELECT item_id, ' ' || array_to_string(ws, ' ') || ' ' AS g FROM i WHERE len(ws) BETWEEN 1 AND 12),
t AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS j FROM d)
SELECT DISTINCT doc_id, item_id FROM dp JOIN ip USING (g) UNION SELECT doc_id, item_id FROM t JOIN s ON contains(j, g)
""".strip()


@query("p9_found", _LEAK_SQL)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold passages of test items, with the items."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p9_spans")
def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The character spans to remove from each document."""
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p10_found", "SELECT DISTINCT doc_id FROM documents WHERE octet_length(encode(text)) > 8192")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that had to be split."""
    pieces = splitting.split_texts(table(spark, d, "documents"), with_text=False)
    return pieces.where("piece_no = 0 AND n_pieces > 1").select("doc_id").distinct()


@query("p10_invariants", "SELECT DISTINCT doc_id, octet_length(encode(text)) AS tokens, true AS within_limit, true AS joined FROM documents WHERE octet_length(encode(text)) > 8192")
def p10_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of every split document: its tokens as the pieces cover them, whether all pieces keep the limit, and whether each overlaps the one before as set."""
    p = splitting.split_texts(table(spark, d, "documents"), with_text=False)
    joined = F.when(F.col("piece_no") == 0, F.col("start_token") == 0).otherwise(F.col("overlap").between(splitting.OVERLAP, splitting.OVERLAP + 3))
    return p.groupBy("doc_id").agg(F.max("end_token").alias("tokens"), F.bool_and(F.col("end_token") - F.col("start_token") <= splitting.LIMIT).alias("within_limit"), F.bool_and(joined).alias("joined"))


@query("p10_pieces")
def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the documents above the limit."""
    return splitting.split_texts(table(spark, d, "documents"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that the grammar of the language their name claims doesn't accept."""
    return parsing.parse_files(table(spark, d, "verified_bytes")).where("NOT valid").select("file_id")


@query("p5_files")
def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """Every parsed file, with the furthest failure and its cause."""
    return parsing.parse_files(table(spark, d, "verified_bytes"))


@query("p5_rates")
def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of files that do not parse, per repository and language."""
    return parsing.failure_rates(parsing.parse_files(table(spark, d, "verified_bytes"))).drop("causes")


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The functions with documentation of their own that says something."""
    return functions.documented_functions(table(spark, d, "verified_bytes"), inherit=False).select("file_id", "start_line", "name")


@query("p7_pairs")
def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of function and description, inherited descriptions included."""
    return functions.documented_functions(table(spark, d, "verified_bytes"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The source files that nobody wrote by hand here."""
    ours = foreign.foreign_files(table(spark, d, "verified_bytes"), judge_all=False).select(F.lit("verified_bytes").alias("record_set"), F.col("file_id").alias("record_id"), "class")
    theirs = foreign.foreign_files(table(spark, d, "recipient_entries"), "entry_id", slug="project_root_identity", judge_all=False)
    both = ours.unionByName(theirs.select(F.lit("recipient_entries").alias("record_set"), F.col("entry_id").alias("record_id"), "class"))
    return both.where("class NOT IN ('hand-written', 'invalid')").select("record_set", "record_id")


@query("p4_files")
def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """Every source file with its class and the evidence."""
    return foreign.foreign_files(table(spark, d, "verified_bytes"))


@query("p4_shared_rules")
def p4_shared_rules(spark: SparkSession, d: str) -> DataFrame:
    """Grammar rules that files share with other repositories."""
    return foreign.shared_rules(table(spark, d, "verified_bytes"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The licence of each source file and pin."""
    return licenses.resolved_licences(table(spark, d, "verified_bytes"), table(spark, d, "license_evidence")).drop("source")


@query("p3_sources")
def p3_sources(spark: SparkSession, d: str) -> DataFrame:
    """The same with what decided."""
    return licenses.resolved_licences(table(spark, d, "verified_bytes"), table(spark, d, "license_evidence"))
