"""Graph queries over the edges customer, order, part, supplier, nation, region, and over the graphs of the records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.operators import graph as G
from pinloom.plans.registry import query
from pinloom.sources.tables import table

#: Node names are the letter of a table and its key.
EDGES = """
edges AS (SELECT 'places' AS kind, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'holds', 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
 UNION SELECT 'from', 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 'in', 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'in', 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
""".strip()
STEPS = "SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node"


def edges(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    parts = [
        t("orders").select(F.lit("places").alias("kind"), key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst")),
        t("lineitem").select(F.lit("holds").alias("kind"), key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst")),
        t("lineitem").select(F.lit("from").alias("kind"), key("p", "l_partkey").alias("src"), key("s", "l_suppkey").alias("dst")),
        t("supplier").select(F.lit("in").alias("kind"), key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst")),
        t("nation").select(F.lit("in").alias("kind"), key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def seeds(spark: SparkSession, d: str, where: str) -> DataFrame:
    return table(spark, d, "customer").where(where).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))


SEEDS = "SELECT 'c' || c_custkey AS node, 0 AS depth FROM customer WHERE c_acctbal > 9950"


@query("reachable", f"WITH RECURSIVE {EDGES}, w(node, depth) AS ({SEEDS} UNION SELECT e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.node) {STEPS}")
def reachable(spark: SparkSession, d: str) -> DataFrame:
    """What the richest customers reach, with the least number of steps."""
    return G.reachable(edges(spark, d), seeds(spark, d, "c_acctbal > 9950"))


@query("shortest_paths", f"WITH RECURSIVE {EDGES}, w(root, node, length, path) AS (SELECT 's' || s_suppkey, 's' || s_suppkey, 0, 's' || s_suppkey FROM supplier UNION SELECT w.root, e.dst, w.length + 1, w.path || '>' || e.dst FROM w JOIN edges e ON e.src = w.node) SELECT root, node, length, min(path) AS path FROM w WHERE length > 0 GROUP BY root, node, length")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """The shortest paths from every supplier."""
    return G.shortest_paths(edges(spark, d), table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")), 8)


_RULES = "rules AS (SELECT 'p' || p_partkey AS node, CASE WHEN p_size % 2 = 0 THEN 'include' ELSE 'external' END AS disposition FROM part UNION ALL SELECT 'o' || o_orderkey, 'include' FROM orders)"


@query("closure", f"WITH RECURSIVE {EDGES}, {_RULES}, w(node, depth) AS ({SEEDS} UNION SELECT e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.node AND e.kind IN ('places', 'holds', 'from') LEFT JOIN rules r ON r.node = w.node WHERE w.depth = 0 OR r.disposition = 'include'), x AS ({STEPS}) SELECT x.node, x.depth, CASE WHEN x.depth = 0 THEN 'include' ELSE coalesce(r.disposition, 'reject') END AS disposition FROM x LEFT JOIN rules r USING (node)")
def closure(spark: SparkSession, d: str) -> DataFrame:
    """The closure that only included nodes expand."""
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.when(F.col("p_size") % 2 == 0, "include").otherwise("external").alias("disposition"))
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), F.lit("include").alias("disposition"))
    return G.closure(edges(spark, d), seeds(spark, d, "c_acctbal > 9950"), ["places", "holds", "from"], parts.unionByName(orders))


@query("dangling_edges", f"WITH {EDGES} SELECT node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) WHERE node NOT IN (SELECT 'c' || c_custkey FROM customer UNION SELECT 'p' || p_partkey FROM part UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'n' || n_nationkey FROM nation)")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    """Ends of edges that the node tables lack: orders and regions are left out of them here."""
    key = lambda name, letter, column: table(spark, d, name).select(F.concat(F.lit(letter), F.col(column).cast("string")).alias("node"))
    nodes = key("customer", "c", "c_custkey").unionByName(key("part", "p", "p_partkey")).unionByName(key("supplier", "s", "s_suppkey")).unionByName(key("nation", "n", "n_nationkey"))
    return G.dangling(edges(spark, d), nodes)


@query("applicable_edges", f"WITH {EDGES} SELECT kind, src, dst FROM edges WHERE src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def applicable_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges that start at suppliers in credit."""
    members = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return G.applicable(edges(spark, d), members).select("kind", "src", "dst")


@query("blocking_paths", f"WITH {EDGES} SELECT a.src AS root, b.dst AS node, 2 AS length, a.src || '>' || a.dst || '>' || b.dst AS path FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src LIKE 's%' AND b.dst IN ('r0', 'r3')")
def blocking_paths(spark: SparkSession, d: str) -> DataFrame:
    """The paths from suppliers that end in one of two regions."""
    roots = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return G.blocking_paths(edges(spark, d), roots, spark.createDataFrame([("r0",), ("r3",)], "node string"), 8).select("root", "node", "length", "path")
