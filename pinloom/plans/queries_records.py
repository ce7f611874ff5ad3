"""Queries over snapshots and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.operators import nested as N
from pinloom.operators.snapshots import snapshot_changes
from pinloom.plans.registry import Query, query
from pinloom.sources.tables import table

SYMBOL_KEYS, SYMBOL_VALUES = ["slug", "qualified_name"], ["kind", "signature", "docstring"]
PARITY_VALUES = ["only_in_git", "only_in_artifact"]
FIRST, LAST = 1, 6

_LATEST = """
{n} AS (SELECT *, row_number() OVER (PARTITION BY snapshot_no, {keys} ORDER BY delivered_at DESC NULLS LAST) AS rn FROM {table}),
{n}1 AS (SELECT * EXCLUDE (rn) FROM {n} WHERE rn = 1 AND snapshot_no BETWEEN 1 AND 6),
{n}2 AS (SELECT coalesce(b.snapshot_no, a.snapshot_no + 1) AS snapshot_no, {out},
  CASE WHEN a.snapshot_no IS NULL THEN 'added' WHEN b.snapshot_no IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM {n}1 a FULL JOIN {n}1 b ON a.snapshot_no + 1 = b.snapshot_no AND {on}
  WHERE (a.snapshot_no IS NULL AND b.snapshot_no > 1) OR (b.snapshot_no IS NULL AND a.snapshot_no < 6)
  OR (a.snapshot_no IS NOT NULL AND b.snapshot_no IS NOT NULL AND ({diff})))"""


def _latest(n: str, name: str, keys: list[str], values: list[str]) -> str:
    return _LATEST.format(
        n=n, table=name, keys=", ".join(keys), out=", ".join(f"coalesce(b.{k}, a.{k}) AS {k}" for k in keys),
        on=" AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys), diff=" OR ".join(f"a.{v} IS DISTINCT FROM b.{v}" for v in values),
    )


@query(
    "p2_found",
    f"WITH {_latest('s', 'symbol_snapshots', SYMBOL_KEYS, SYMBOL_VALUES).strip()}, {_latest('q', 'parity_results', ['slug'], PARITY_VALUES).strip()}"
    " SELECT 'symbol' AS record_set, CAST(snapshot_no AS INTEGER) AS snapshot_no, slug, qualified_name, change_kind FROM s2"
    " UNION ALL SELECT 'parity', CAST(snapshot_no AS INTEGER), slug, '', change_kind FROM q2",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Which symbols and parity rows were added, removed or changed between consecutive snapshots."""
    symbols = snapshot_changes(table(spark, d, "symbol_snapshots"), SYMBOL_KEYS, SYMBOL_VALUES, FIRST, LAST)
    parity = snapshot_changes(table(spark, d, "parity_results"), ["slug"], PARITY_VALUES, FIRST, LAST).withColumn("qualified_name", F.lit(""))
    columns = ["record_set", "snapshot_no", "slug", "qualified_name", "change_kind"]
    return symbols.withColumn("record_set", F.lit("symbol")).select(*columns).unionByName(parity.withColumn("record_set", F.lit("parity")).select(*columns))


@query(
    "p2_change_values",
    f"WITH {_latest('s', 'symbol_snapshots', SYMBOL_KEYS, SYMBOL_VALUES).strip()}"
    " SELECT CAST(c.snapshot_no AS INTEGER) AS snapshot_no, c.slug, c.qualified_name, c.change_kind, a.kind AS old_kind, b.kind AS new_kind,"
    " a.signature AS old_signature, b.signature AS new_signature, a.docstring AS old_docstring, b.docstring AS new_docstring FROM s2 c"
    " LEFT JOIN s1 a ON a.snapshot_no = c.snapshot_no - 1 AND a.slug IS NOT DISTINCT FROM c.slug AND a.qualified_name IS NOT DISTINCT FROM c.qualified_name"
    " LEFT JOIN s1 b ON b.snapshot_no = c.snapshot_no AND b.slug IS NOT DISTINCT FROM c.slug AND b.qualified_name IS NOT DISTINCT FROM c.qualified_name",
)
def p2_change_values(spark: SparkSession, d: str) -> DataFrame:
    """The same changes of symbols with the old and new values."""
    changes = snapshot_changes(table(spark, d, "symbol_snapshots"), SYMBOL_KEYS, SYMBOL_VALUES, FIRST, LAST, with_values=True)
    sides = [F.col(f"{side}_values.{v}").alias(f"{side}_{v}") for v in SYMBOL_VALUES for side in ("old", "new")]
    return changes.select("snapshot_no", *SYMBOL_KEYS, "change_kind", *sides)


# DuckDB reads '$' paths on JSON; arrays stand as they are, an object as an array of one
_OPEN = (
    "WITH a AS (SELECT DISTINCT record_id, payload FROM raw_records WHERE json_valid(payload)),"
    " b AS (SELECT record_id, CASE WHEN json_type(payload) = 'VARCHAR' THEN payload ->> '$' ELSE payload END AS t FROM a),"
    " r AS (SELECT record_id, CAST(t AS JSON) AS j FROM b WHERE json_valid(t)),"
    " e0 AS (SELECT record_id, j -> '$.golden.edges' AS x FROM r), t0 AS (SELECT record_id, j -> '$.tasks' AS x FROM r),"
    " e AS (SELECT record_id, unnest(CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END) AS v,"
    " generate_subscripts(CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END, 1) - 1 AS i FROM e0),"
    " t AS (SELECT record_id, unnest(CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END) AS v,"
    " generate_subscripts(CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END, 1) - 1 AS i FROM t0),"
    " q0 AS (SELECT record_id, i AS p, v -> '$.gold.candidate_qrels' AS x FROM t), j0 AS (SELECT record_id, i AS p, v -> '$.judgments' AS x FROM t),"
    " q AS (SELECT record_id, p, unnest(CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END) AS v,"
    " generate_subscripts(CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END, 1) - 1 AS i FROM q0),"
    " g AS (SELECT record_id, p, unnest(CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END) AS v,"
    " generate_subscripts(CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END, 1) - 1 AS i FROM j0)"
)


@query(
    "p6_found",
    _OPEN
    + " SELECT record_id, 'site' AS entity, 0 AS parent_pos, CAST(i AS INTEGER) AS pos FROM e WHERE coalesce(json_type(v -> '$.provenance.site.end_line'), 'NULL') <> 'NULL'"
    " UNION ALL SELECT record_id, 'binding', 0, CAST(i AS INTEGER) FROM e WHERE coalesce(json_type(v -> '$.provenance.binding.commit_sha'), 'NULL') <> 'NULL'"
    " UNION ALL SELECT record_id, 'qrel', CAST(p AS INTEGER), CAST(i AS INTEGER) FROM q WHERE coalesce(json_type(v -> '$.grade'), 'NULL') <> 'NULL'"
    " UNION ALL SELECT record_id, 'judgment', CAST(p AS INTEGER), CAST(i AS INTEGER) FROM g WHERE coalesce(json_type(v -> '$.source.path'), 'NULL') <> 'NULL'",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Sites, bindings, qrels and judgments nested in the payloads, linked to their places."""
    return N.entity_index(table(spark, d, "raw_records"), [N.SITES, N.BINDINGS, N.QRELS, N.JUDGMENTS], "payload", "record_id")


def _flat(target: N.Target) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return N.flat_table(table(spark, d, "raw_records"), target, "payload", ["record_id"])

    return run


query("p6_edges", _OPEN + " SELECT record_id, CAST(i AS INTEGER) AS pos_0, v ->> '$.kind' AS kind, v ->> '$.source.qualified_name' AS source_name, v ->> '$.target.qualified_name' AS target_name FROM e")(_flat(N.EDGES))
query("p6_tasks", _OPEN + " SELECT record_id, CAST(i AS INTEGER) AS pos_0, v ->> '$.task_id' AS task_id FROM t")(_flat(N.TASKS))


def _span_sql(prefix: str) -> str:
    texts = [f"v ->> '$.{prefix}.{f}' AS {f}" for f in N.SPAN]
    return ", ".join([*texts, *(f"TRY_CAST(CASE WHEN json_type(v -> '$.{prefix}.{f}') IN ('UBIGINT', 'BIGINT', 'VARCHAR', 'DOUBLE') THEN v ->> '$.{prefix}.{f}' END AS INTEGER) AS {f}" for f in ("start_line", "end_line"))])


def _there(path: str) -> str:
    return f"coalesce(json_type(v -> '$.{path}'), 'NULL') <> 'NULL'"


query("p6_sites", _OPEN + f" SELECT record_id, CAST(i AS INTEGER) AS pos_0, {_span_sql('provenance.site')} FROM e WHERE {_there('provenance.site.end_line')}")(_flat(N.SITES))
query("p6_bindings", _OPEN + f" SELECT record_id, CAST(i AS INTEGER) AS pos_0, {_span_sql('provenance.binding')} FROM e WHERE {_there('provenance.binding.commit_sha')}")(_flat(N.BINDINGS))
query("p6_qrels", _OPEN + f" SELECT record_id, CAST(p AS INTEGER) AS pos_0, CAST(i AS INTEGER) AS pos_1, v ->> '$.grade' AS grade, {_span_sql('identity')} FROM q WHERE {_there('grade')}")(_flat(N.QRELS))
query("p6_judgments", _OPEN + f" SELECT record_id, CAST(p AS INTEGER) AS pos_0, CAST(i AS INTEGER) AS pos_1, v ->> '$.grade' AS grade, {_span_sql('source')} FROM g WHERE {_there('source.path')}")(_flat(N.JUDGMENTS))
