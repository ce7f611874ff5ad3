"""What changed between consecutive full snapshots of a table.

Every row is reduced to a compact record: a 128-bit hash of its key and a 128-bit hash of its compared values. Repeated and
superseded deliveries are settled by a combining aggregate before anything is shuffled, the compact records are spread over
hash buckets, and every bucket sorts its arrays in numpy and takes set differences with searchsorted. Full values are fetched
only for keys that differ.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinloom.plans.sizing import partitions_for

ADDED, REMOVED, CHANGED = 0, 1, 2
KINDS = ("added", "removed", "changed")


def null_safe_hash(columns: Sequence[str], salt: int) -> Column:
    """A 64-bit hash in which null differs from every value and from a missing neighbour."""
    parts: list[Column] = [F.lit(salt)]
    for name in columns:
        parts += [F.col(f"`{name}`"), F.col(f"`{name}`").isNull()]
    return F.xxhash64(*parts)


def bucket_changes(snapshot: np.ndarray, k1: np.ndarray, k2: np.ndarray, v1: np.ndarray, v2: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
    """The differences within one bucket, which holds one record for each key and snapshot.

    Returns (snapshot_no, k1, k2, kind). Keys are ranked after one sort, so that each snapshot is a sorted array of ranks.
    """
    order = np.lexsort((snapshot, k2, k1))
    snapshot, k1, k2, v1, v2 = (a[order] for a in (snapshot, k1, k2, v1, v2))
    fresh = np.ones(len(k1), dtype=bool)
    fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    rank = np.cumsum(fresh) - 1
    at = {s: np.flatnonzero(snapshot == s) for s in range(first, last + 1)}
    out: list[tuple[np.ndarray, ...]] = []
    for s in range(first + 1, last + 1):
        old, new = at[s - 1], at[s]
        old_rank, new_rank = rank[old], rank[new]
        place = np.searchsorted(old_rank, new_rank)
        hit = place < len(old_rank)
        hit[hit] = old_rank[place[hit]] == new_rank[hit]
        back = np.searchsorted(new_rank, old_rank)
        kept = back < len(new_rank)
        kept[kept] = new_rank[back[kept]] == old_rank[kept]
        a, b = old[place[hit]], new[hit]
        differs = (v1[a] != v1[b]) | (v2[a] != v2[b])
        for rows, kind in ((new[~hit], ADDED), (old[~kept], REMOVED), (b[differs], CHANGED)):
            out.append((np.full(len(rows), s, np.int64), k1[rows], k2[rows], np.full(len(rows), kind, np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int32))


def _differ(first: int, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        s, a, b, k = bucket_changes(*(held[c].to_numpy() for c in ("_s", "_k1", "_k2", "_v1", "_v2")), first, last)
        for i in range(0, len(s), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (s, a, b, k)], names=["_s", "_k1", "_k2", "_kind"])

    return run


def snapshot_changes(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    first: int,
    last: int,
    snapshot: str = "snapshot_no",
    delivered: str = "delivered_at",
    with_values: bool = False,
) -> DataFrame:
    """Rows added, removed or changed between snapshot s - 1 and s, for s from ``first`` + 1 to ``last``.

    Columns: ``snapshot``, the keys, ``change_kind``; with ``with_values`` also the structs ``old_values`` and ``new_values``.
    Null equals null, in keys and in values. Of several rows of a key in one snapshot the one delivered last counts, null
    being earliest; rows delivered at the same time are settled by the greatest row hash. Rows without a snapshot number
    belong to none and are left out. Other columns are ignored, an empty table gives an empty result.
    """
    # values travel only where they are asked for; changes themselves are told by hashes
    names = [*keys, *values] if with_values else list(keys)
    base = df.where(F.col(f"`{snapshot}`").between(first, last)).select(
        F.col(f"`{snapshot}`").cast("long").alias("_s"),
        null_safe_hash(keys, 1).alias("_k1"),
        null_safe_hash(keys, 2).alias("_k2"),
        F.struct(F.col(f"`{delivered}`").alias("d"), null_safe_hash(values, 3).alias("v1"), null_safe_hash(values, 4).alias("v2")).alias("_r"),
        *[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)],
    )
    compact = base.groupBy("_s", "_k1", "_k2").agg(F.max("_r").alias("_r"))
    arrays = compact.select("_s", "_k1", "_k2", F.col("_r.v1").alias("_v1"), F.col("_r.v2").alias("_v2"))
    changes = arrays.repartition(partitions_for(df), "_k1").mapInArrow(_differ(first, last), "_s long, _k1 long, _k2 long, _kind int")
    # a change of kind "changed" or "added" is seen in its own snapshot, a removal in the one before
    sides = F.array(F.lit(0), F.lit(1)) if with_values else F.when(F.col("_kind") == REMOVED, F.array(F.lit(1))).otherwise(F.array(F.lit(0)))
    wanted = changes.withColumn("_back", F.explode(sides)).withColumn("_at", F.col("_s") - F.col("_back"))
    full = base.withColumnRenamed("_s", "_at")
    found = wanted.join(full, ["_at", "_k1", "_k2"])
    chosen = found.groupBy("_at", "_k1", "_k2", "_s", "_kind", "_back").agg(F.max_by(F.struct(*[f"_c{i}" for i in range(len(names))]), "_r").alias("_f"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("_kind") + 1)
    key_columns = [F.col(f"_f._c{i}").alias(n) for i, n in enumerate(keys)]
    if not with_values:
        return chosen.select(F.col("_s").cast("int").alias(snapshot), *key_columns, kind.alias("change_kind"))
    packed = F.struct(*[F.col(f"_f._c{len(keys) + i}").alias(n) for i, n in enumerate(values)])
    both = chosen.groupBy("_k1", "_k2", "_s", "_kind").agg(
        F.max(F.when(F.col("_back") == 1, packed)).alias("old_values"),
        F.max(F.when(F.col("_back") == 0, packed)).alias("new_values"),
        F.first("_f").alias("_f"),
    )
    return both.select(F.col("_s").cast("int").alias(snapshot), *key_columns, kind.alias("change_kind"), "old_values", "new_values")
