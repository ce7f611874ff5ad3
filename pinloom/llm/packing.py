"""Filling containers of fixed capacity with items, by exact-complement hashing.

The lengths of a shard become a histogram, which has at most ``capacity`` entries however many items there are. For the
longest remaining length the gap it leaves is looked up among the sums of one, two and three lengths; a combination that
fills the gap exactly is consumed as often as the counts allow. A gap that no combination fills takes the length that fits
best, and the rest is looked up again. Items are then handed to the containers length by length. Items above the capacity are cut into full containers and a rest; no other item is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinloom.llm.tokenizers import FOLDER, counter
from pinloom.plans.sizing import input_bytes

CAPACITY = 8192
#: Stored bytes of a shard. A shard wastes at most a few containers, of the tens of thousands it fills.
SHARD_BYTES = 64 << 20
#: Containers are numbered within the shard, which stands in the bits above these.
SHARD_SHIFT = 40


class SumIndex:
    """Sums of one, two and three available lengths, each with one combination that makes it.

    A combination may have become unavailable since; then another is sought before the sum counts as out of reach.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.size = len(counts)
        self.pairs: dict[int, int] = {}
        self.dead: set[tuple[int, int]] = set()

    def usable(self, lengths: tuple[int, ...]) -> int:
        """How many times the combination can be consumed."""
        return min(int(self.counts[x]) // lengths.count(x) for x in lengths)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.counts[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two lengths that sum to the gap, the first the larger."""
        if (a := self.pairs.get(gap)) is not None and self.counts[a] and self.counts[gap - a] and self.usable((a, gap - a)):
            return (a, gap - a)
        if (2, gap) in self.dead:  # counts only fall
            return None
        half = np.arange((gap + 1) // 2, gap)
        for a in half[(self.counts[half] > 0) & (self.counts[gap - half] > 0)][::-1]:
            if self.usable((int(a), int(gap - a))):
                self.pairs[gap] = int(a)
                return (int(a), int(gap - a))
        self.dead.add((2, gap))
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths that sum to the gap, the first the largest."""
        if (3, gap) in self.dead:
            return None
        first = np.flatnonzero(self.counts[:gap])
        for a in first[first * 3 >= gap][::-1]:
            rest = gap - int(a)
            if rest > 1 and (two := self.pair(rest)) and self.usable(found := (int(a), *two)):
                return found
        self.dead.add((3, gap))
        return None

    def fill(self, gap: int, longest: int) -> tuple[int, ...] | None:
        """One, two or three lengths, none above ``longest``, that fill the gap exactly."""
        if gap > 3 * longest:
            return None
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """A container for each item (lengths from 0 to ``capacity``), and how many containers there are.

    Items of equal length are interchangeable; they are taken in the order given. Items of length 0 go to container 0.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    counts = np.bincount(lengths, minlength=capacity + 1)
    empty, counts[0] = int(counts[0]), 0
    index = SumIndex(counts)
    used: dict[int, list[np.ndarray]] = {}
    made = 0
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            whole, gap, best = [longest], capacity - longest, longest
            counts[longest] -= 1
            while gap:
                if combination := index.fill(gap, best):
                    for x in combination:
                        counts[x] -= 1
                    whole += combination
                    break
                fitting = np.flatnonzero(counts[1 : min(gap, best) + 1])
                if not len(fitting):
                    break
                best = int(fitting[-1]) + 1  # no longer length can be there for the rest of this container
                counts[best] -= 1
                whole.append(best)
                gap -= best
            more = index.usable(tuple(whole))
            for x in set(whole):
                times = whole.count(x)
                used.setdefault(x, []).append(np.repeat(np.arange(made, made + more + 1), times))
                counts[x] -= more * times
            made += more + 1
    out = np.zeros(len(lengths), dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    start = empty
    for length in sorted(used):
        containers = np.concatenate(used[length])
        out[order[start : start + len(containers)]] = containers
        start += len(containers)
    return out, max(made, int(empty > 0))


COUNTED = pa.schema([("_id", pa.int64()), ("_n", pa.int64())])
PACKED = pa.schema([("_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int32()), ("container_id", pa.int64())])
PACKED_DDL = "_id long, piece_no int, start_token long, n_tokens int, container_id long"


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str, folder: str) -> DataFrame:
    """(_id, _n): the tokens of each text; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, folder)
        for batch in batches:
            sizes = [count(t.decode("utf-8", "replace")) if t else 0 for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), pa.array(sizes, pa.int64())], schema=COUNTED)

    return df.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("binary").alias("_t")).mapInArrow(run, "_id long, _n long")


def pack_texts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, capacity: int = CAPACITY) -> DataFrame:
    """An assignment of all texts to containers of ``capacity`` tokens.

    Columns: ``key``, piece_no (from 0), start_token, n_tokens, container_id. A text above the capacity gives full pieces and a
    rest; every other text is one piece. Null and empty texts have 0 tokens and are assigned too. Repeated rows are repeated
    items. Other columns are ignored. An empty table gives an empty result.
    """
    shards = int(stored_bytes(df, text) / SHARD_BYTES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            shard, ids, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_shard", "_id", "_n"))
            missing = batch.column("_id").is_null().to_numpy(zero_copy_only=False)
            for s in np.unique(shard):
                held.setdefault(int(s), []).append((ids[shard == s], sizes[shard == s], missing[shard == s]))
        for shard, parts in held.items():
            ids, sizes, missing = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((sizes, ids))
            ids, sizes, missing = ids[order], sizes[order], missing[order]
            pieces = np.maximum(1, -(-sizes // capacity))
            row = np.repeat(np.arange(len(ids)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(capacity, sizes[row] - number * capacity)
            containers, _ = pack_lengths(length, capacity)
            keys = pa.array([None if m else int(i) for i, m in zip(ids[row], missing[row])], pa.int64()) if missing.any() else pa.array(ids[row].astype(np.int64))
            arrays = [keys, pa.array(number, pa.int32()), pa.array(number * capacity, pa.int64()), pa.array(length, pa.int32()), pa.array(containers + (shard << SHARD_SHIFT))]
            whole = pa.RecordBatch.from_arrays(arrays, schema=PACKED)
            for i in range(0, whole.num_rows, 100_000):
                yield whole.slice(i, 100_000)

    counted = token_counts(df, key, text, tokenizer, folder).withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)))
    return counted.repartition(shards, "_shard").mapInArrow(run, PACKED_DDL).withColumnRenamed("_id", key)


def stored_bytes(df: DataFrame, text: str) -> int:
    """The bytes of the tables that ``df`` reads; where Spark can't tell them, those of the texts."""
    return input_bytes(df) or int(df.agg(F.coalesce(F.sum(F.octet_length(f"`{text}`")), F.lit(0)).alias("n")).collect()[0]["n"])


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The containers with their items and fill."""
    return packed.groupBy("container_id").agg(
        F.count("*").alias("items"), F.sum("n_tokens").alias("filled"), (F.lit(capacity) - F.sum("n_tokens")).alias("unused")
    )


