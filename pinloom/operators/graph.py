"""Reachability and shortest paths over edge tables, one join per level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinloom.operators.ranking import globally_ranked
from pinloom.plans.sizing import checkpointed, partitions_for

MAX_DEPTH = 1000


def prepared(edges: DataFrame, *more: str) -> DataFrame:
    """Distinct edges, written once in the partitioning that every round's join needs, so that no round makes them again."""
    one = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", *more).distinct()
    return checkpointed(one.repartition(partitions_for(edges), "src"))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(node, depth): the nodes reached from the seeds (node) along edges (src, dst), with the least number of steps.

    Each round joins the frontier with the edges, drops what is known and writes the rest, so that the lineage stays short and
    a lost executor costs one round. Cycles end, as known nodes don't return. Null nodes are no nodes.
    """
    edges = prepared(edges)
    found = checkpointed(seeds.where("node IS NOT NULL").select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = found
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
        if depth % 8 == 0:
            found = checkpointed(found)
    raise ValueError(f"more than {max_depth} levels")


def shortest_paths(edges: DataFrame, roots: DataFrame, max_length: int, separator: str = ">") -> DataFrame:
    """(root, node, length, path): the shortest path from each root, of equally long ones the first in text order.

    Paths keep the keys of their nodes; a path longer than ``max_length`` is an error if it were needed. Roots are left out.
    """
    edges = prepared(edges.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    known = checkpointed(roots.select(F.col("node").cast("string").alias("root")).where("root IS NOT NULL").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("length"), F.col("root").alias("path")))
    frontier = known
    for length in range(1, max_length + 2):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.concat("path", F.lit(separator), "dst").alias("path"))
        best = step.groupBy("root", "node").agg(F.min("path").alias("path")).withColumn("length", F.lit(length))
        frontier = checkpointed(best.join(known.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", "length", "path"))
        if frontier.isEmpty():
            return known.where("length > 0")
        if length > max_length:
            raise ValueError(f"a path is longer than {max_length}")
        known = known.unionByName(frontier)
    return known.where("length > 0")


def closure(edges: DataFrame, seeds: DataFrame, kinds: list[str], rules: DataFrame, default: str = "reject") -> DataFrame:
    """The closure over runtime edges (kind, src, dst) with a disposition for each target: (node, depth, disposition).

    ``rules`` has (node, disposition). Seeds are included. Only included nodes are expanded; what no rule names has the
    default. A rejected node makes the closure rejected, which the caller sees in its row.
    """
    runtime = edges.where(F.col("kind").isin(*kinds))
    told = rules.groupBy("node").agg(F.min("disposition").alias("_d"))
    own = seeds.select(F.col("node").alias("_seed")).distinct()
    expands = runtime.select("src").distinct().join(told, F.col("src") == F.col("node"), "left").join(own, F.col("src") == F.col("_seed"), "left")
    expands = expands.where((F.coalesce("_d", F.lit(default)) == "include") | F.col("_seed").isNotNull()).select("src")
    inner = runtime.join(expands, "src", "left_semi").select("src", "dst")
    out = reachable(inner, seeds)
    named = out.join(told, "node", "left")
    return named.select("node", "depth", F.when(F.col("depth") == 0, "include").otherwise(F.coalesce("_d", F.lit(default))).alias("disposition"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ends of edges that are no nodes."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti")


def applicable(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges that start at a member."""
    return edges.join(members.select(F.col("node").alias("src")).distinct(), "src", "left_semi")


def blocking_paths(edges: DataFrame, roots: DataFrame, blocking: DataFrame, max_length: int) -> DataFrame:
    """The shortest paths from roots to blocking targets: (root, node, length, path).

    Only edges from which a target can still be reached are walked: these are found backward from the targets, few as they
    are, so that paths that end elsewhere are never made.
    """
    backward = edges.select(F.col("dst").cast("string").alias("src"), F.col("src").cast("string").alias("dst"))
    useful = reachable(backward, blocking.select(F.col("node").cast("string"))).select("node")
    inner = edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).join(useful.select(F.col("node").alias("dst")), "dst", "left_semi")
    paths = shortest_paths(inner, roots, max_length)
    return paths.join(blocking.select(F.col("node").cast("string")).distinct(), "node", "left_semi")


def async_assessment(paths: DataFrame, catalog: DataFrame, external: DataFrame) -> DataFrame:
    """Per root: incompatible if a path ends at a cataloged blocking target, else unknown if one ends at an external node, else compatible."""
    ends = paths.join(catalog.select("node", F.lit(True).alias("_b")).distinct(), "node", "left").join(external.select("node", F.lit(True).alias("_e")).distinct(), "node", "left")
    blocked, unknown = F.coalesce(F.bool_or("_b"), F.lit(False)), F.coalesce(F.bool_or("_e"), F.lit(False))
    return ends.groupBy("root").agg(F.when(blocked, "incompatible").when(unknown, "unknown").otherwise("compatible").alias("state"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often: what must be empty where keys must be unique."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def classified_edges(edges: DataFrame, rules: DataFrame, allowed: DataFrame) -> DataFrame:
    """Each edge with the disposition of its target: the target's own rule, else include for donor nodes, else external for allowed
    standard nodes, else reject.

    ``edges`` has (src, dst, dst_origin), ``rules`` (node, disposition), ``allowed`` (node). A node of several rules takes the first
    in text order.
    """
    told = rules.groupBy(F.col("node").alias("dst")).agg(F.min("disposition").alias("_d"))
    pure = allowed.select(F.col("node").alias("dst")).distinct().withColumn("_p", F.lit(True))
    by = F.when(F.col("_d").isNotNull(), F.col("_d")).when(F.col("dst_origin") == "donor", "include").when((F.col("dst_origin") == "stdlib") & F.col("_p"), "external").otherwise("reject")
    level = F.when(F.col("_d").isNotNull(), "rule").when(F.col("dst_origin") == "donor", "origin").when((F.col("dst_origin") == "stdlib") & F.col("_p"), "allowlist").otherwise("none")
    return edges.join(told, "dst", "left").join(pure, "dst", "left").withColumn("disposition", by).withColumn("decided_by", level).drop("_d", "_p")


def import_support(runtime: DataFrame, imports: DataFrame) -> DataFrame:
    """The imports whose binding or site is the binding of a runtime edge: (edge, import), as a union of two equi-joins.

    ``runtime`` has (edge, binding), ``imports`` (import, binding, site). Null bindings support nothing.
    """
    keys = imports.select("import", F.col("binding").alias("key")).unionByName(imports.select("import", F.col("site").alias("key"))).where("key IS NOT NULL").distinct()
    return runtime.select("edge", F.col("binding").alias("key")).where("key IS NOT NULL").join(keys, "key").select("edge", "import").distinct()


def seed_nodes(nodes: DataFrame, kinds: list[str], name: str | None = None) -> DataFrame:
    """Donor nodes that a closure may start at: (node, qualified_name, state); a name that several nodes hold is ambiguous."""
    fit = nodes.where((F.col("origin") == "donor") & F.col("kind").isin(*kinds))
    fit = fit.where(F.col("qualified_name") == name) if name is not None else fit
    counts = fit.groupBy("qualified_name").agg(F.count("*").alias("_n"), F.min("node").alias("node"))
    return counts.select("qualified_name", F.when(F.col("_n") == 1, F.col("node")).alias("node"), F.when(F.col("_n") == 1, "resolved").otherwise("ambiguous").alias("state"))


def budgeted_closure(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, unresolved: DataFrame, max_depth: int, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """The closure from seeds over classified edges, with its budgets: members and one row of counts and status.

    ``edges`` has (src, dst, disposition), as ``classified_edges`` gives it; only included targets are expanded. Members are
    (node, depth, position): position is the order by depth and node in which the budget of nodes is spent, and nodes beyond it
    or beyond the depth are the frontier, state ``frontier``. A rejected edge or an unresolved reference at a member rejects the
    closure, which outweighs a spent budget; a budget spent makes it partial.
    """
    runtime = checkpointed(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "disposition").distinct().repartition(partitions_for(edges), "src"))
    reached = reachable(runtime.where("disposition = 'include'"), seeds)
    known = reached.join(nodes.select("node").distinct(), "node", "left_semi")
    placed = globally_ranked(known, [F.col("depth").asc(), F.col("node").asc()], "position")
    state = F.when((F.col("depth") > max_depth) | (F.col("position") > max_nodes), "frontier").otherwise("member")
    members = checkpointed(placed.select("node", "depth", F.col("position").cast("long").alias("position"), state.alias("state")))
    inside = members.where("state = 'member'").select(F.col("node").alias("src"))
    seen = runtime.join(inside, "src", "left_semi")
    counts = seen.agg(F.count("*").alias("edges"), F.count_if(F.col("disposition") == "reject").alias("rejected"), F.count_distinct(F.when(F.col("disposition") == "external", F.col("dst"))).alias("external"))
    open_ = unresolved.select(F.col("node").alias("src")).join(inside, "src", "left_semi").agg(F.count("*").alias("unresolved"))
    sizes = members.agg(F.count_if(F.col("state") == "member").alias("members"), F.count_if(F.col("state") == "frontier").alias("frontier"), F.coalesce(F.max(F.when(F.col("state") == "member", F.col("depth"))), F.lit(0)).alias("depth"))
    status = F.when((F.col("rejected") > 0) | (F.col("unresolved") > 0), "reject").when((F.col("frontier") > 0) | (F.col("edges") > max_edges), "partial").otherwise("complete")
    # three rows of one line each
    return members, sizes.join(F.broadcast(counts)).join(F.broadcast(open_)).withColumn("status", status)


def nodes_of_symbols(symbols: DataFrame) -> DataFrame:
    """A node table from a symbol table: one donor node for each (kind, module, qualified_name)."""
    return symbols.where("qualified_name IS NOT NULL").select(F.lit("donor").alias("origin"), "kind", F.coalesce("module", F.lit("")).alias("module"), "qualified_name").distinct()


def needed_names(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): the module-level names that seeds (node) need, directly or through others, along reads, calls, bases and constructions."""
    kinds = ("reads", "calls", "inherits", "instantiates", "raises")
    return reachable(edges.where(F.col("kind").isin(*kinds)).select("src", "dst"), seeds)


def walk_tree(entries: DataFrame, root: DataFrame, max_depth: int = 64) -> DataFrame:
    """(path, sha, mode): the files below root trees (tree), from entries (tree, name, kind tree or blob, sha, mode), level by level.

    A tree deeper than ``max_depth`` raises ValueError. A path that two entries give is an error too, as in one tree names are unique.
    """
    entries = checkpointed(entries.distinct().repartition(partitions_for(entries), "tree"))
    level = root.select(F.col("tree").alias("_t"), F.lit("").alias("_p")).distinct()
    found = None
    for _ in range(max_depth):
        step = checkpointed(level.join(entries, F.col("_t") == F.col("tree")).select(F.concat("_p", "name").alias("path"), "kind", "sha", "mode"))
        files = step.where("kind = 'blob'").select("path", "sha", "mode")
        found = files if found is None else found.unionByName(files)
        level = step.where("kind = 'tree'").select(F.col("sha").alias("_t"), F.concat("path", F.lit("/")).alias("_p"))
        if level.isEmpty():
            if not duplicates(found, ["path"]).isEmpty():
                raise ValueError("a path stands twice in the tree")
            return found
    raise ValueError(f"a tree is deeper than {max_depth}")
