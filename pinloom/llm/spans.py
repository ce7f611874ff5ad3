"""Long exact spans shared between records, by repeated-phrase automata.

A phrase is a run of ``run`` consecutive lines. Every phrase lies in a passage: neighbouring phrases with one minimizer, the
least hash among the groups of a few lines that they hold, so that equal phrases have equal minimizers. Passages whose
minimizer occurs in one record alone are dropped. The others are routed to shards by their minimizer, one text for all copies.
Every shard confirms the phrases that records share by the bytes of their lines, compiles them into an Aho-Corasick automaton
over line symbols, and streams its passages through it to locate every occurrence. As equal phrases always meet in one shard,
no document need be streamed against the automata of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinloom.llm.arrow import batches_of, columns
from pinloom.plans.sizing import checkpointed, partitions_for

RUN = 12
#: Lines hashed together for the minimizer. More than one, so that lines common everywhere don't draw all passages.
SHINGLE = 4
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def lines_of(content: bytes | None) -> list[bytes]:
    r"""The lines of a file, separated by ``\\n``; an empty piece after the last one is no line."""
    parts = (content or b"").split(b"\n")
    if parts[-1] == b"":
        parts.pop()
    return parts


def line_hashes(lines: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))


def rolled(hashes: np.ndarray, width: int, mix: np.uint64) -> np.ndarray:
    """A hash of every run of ``width`` hashes, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out = (out ^ (out >> np.uint64(29))) * mix + hashes[i : i + n]
        return (out ^ (out >> np.uint64(32))) * mix


def minimizers(hashes: np.ndarray, run: int, shingle: int) -> np.ndarray:
    """For each run of lines the least hash among its shingles; the same for equal runs, wherever they stand."""
    parts = rolled(hashes, shingle, _MIX2)
    width = run - shingle + 1
    if len(parts) < width:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(parts, width).min(axis=1)


def passages(hashes: np.ndarray, run: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first line, lines) of each passage."""
    least = minimizers(hashes, run, shingle)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return least[first].view(np.int64), first, np.diff(np.append(first, len(least))) + run - 1


PASSAGES = pa.schema([("_m", pa.int64()), ("_id", pa.int64()), ("_at", pa.int32()), ("_n", pa.int32()), ("_p", pa.binary())])
TEXTS = pa.schema([("_m", pa.int64()), ("_p", pa.binary()), ("_t", pa.binary()), ("_low", pa.int64()), ("_high", pa.int64())])


def _passages(run: int, shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, content in columns(batch, "_id", "_c"):
                lines = lines_of(content)
                if len(lines) < run:
                    continue
                ends = np.cumsum([len(x) + 1 for x in lines])
                for m, at, n in zip(*(x.tolist() for x in passages(line_hashes(lines), run, shingle))):
                    begin = ends[at - 1] if at else 0
                    yield m, i, at, n, xxhash.xxh3_128_digest(content[begin : ends[at + n - 1] - 1])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), PASSAGES)

    return go


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the passages that a record stands for."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for content, wanted in columns(batch, "_c", "_w"):
                lines = lines_of(content)
                for w in wanted:
                    yield w["m"], w["p"], b"\n".join(lines[w["at"] : w["at"] + w["n"]]), w["low"], w["high"]

    return batches_of(rows(), TEXTS, 2_000)


def confirmed(texts: list[bytes], low: list[int], high: list[int], run: int) -> list[list[tuple[int, int]]]:
    """For each passage of a shard the line spans [a, b) that its confirmed phrases cover.

    ``low`` and ``high`` are the least and greatest record that holds the passage. A phrase is confirmed if records that
    differ hold it; the lines are compared byte for byte, since equal symbols are equal lines.
    """
    symbols: dict[bytes, int] = {}
    streams = [tuple(symbols.setdefault(x, len(symbols)) for x in t.split(b"\n")) for t in texts]
    owner: dict[tuple[int, ...], int] = {}
    shared: set[tuple[int, ...]] = set()
    for stream, a, b in zip(streams, low, high):
        for k in range(len(stream) - run + 1):
            phrase = stream[k : k + run]
            if a != b or owner.setdefault(phrase, a) != a:
                shared.add(phrase)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase in shared:
        automaton.add_word(phrase, True)
    if not shared:
        return [[] for _ in streams]
    automaton.make_automaton()
    out: list[list[tuple[int, int]]] = []
    for stream in streams:
        spans: list[tuple[int, int]] = []
        for end, _ in automaton.iter(stream):
            a, b = end - run + 1, end + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        out.append(spans)
    return out


SHARED = pa.schema([("_m", pa.int64()), ("_p", pa.binary()), ("_spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
#: Passages of one automaton. A partition's passages arrive sorted by minimizer, and one minimizer is never split.
SHARD_ROWS = 50_000
#: Different passages of one minimizer, above which its phrases are compared one by one, spread by their own hashes.
HOT_PASSAGES = 10_000
PHRASES = pa.schema([("_m", pa.int64()), ("_p", pa.binary()), ("_a", pa.int32()), ("_h", pa.binary()), ("_low", pa.int64()), ("_high", pa.int64())])


def _confirm(run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        def flush(group: list[tuple]) -> Iterator[tuple]:
            spans = confirmed([g[2] for g in group], [g[3] for g in group], [g[4] for g in group], run)
            for g, own in zip(group, spans):
                if own:
                    yield g[0], g[1], [{"a": a, "b": b} for a, b in own]

        held: list[tuple] = []
        for batch in batches:
            for row in columns(batch, "_m", "_p", "_t", "_low", "_high"):
                if len(held) >= SHARD_ROWS and row[0] != held[-1][0]:
                    yield from flush(held)
                    held = []
                held.append(row)
        if held:
            yield from flush(held)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), SHARED, 5_000)

    return go


def _phrases(run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for m, p, t, low, high in columns(batch, "_m", "_p", "_t", "_low", "_high"):
                lines = t.split(b"\n")
                for k in range(len(lines) - run + 1):
                    yield m, p, k, xxhash.xxh3_128_digest(b"\n".join(lines[k : k + run])), low, high

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), PHRASES)

    return go


def shared_spans(df: DataFrame, key: str = "file_id", content: str = "content", run: int = RUN, shingle: int = SHINGLE) -> DataFrame:
    """The maximal blocks of shared lines of every record: (key, start_line, end_line, shared_lines), lines counted from 1.

    A line is shared if it lies in a run of ``run`` consecutive lines that occurs byte for byte in a record with another key.
    Copies of a passage are told by a 128-bit hash, the lines of different passages byte by byte. shared_lines is the sum over the record's blocks. Repeated rows count once. Records with null or empty content, or with
    fewer lines than a run, have none; so have records without a key. Other columns are ignored.
    """
    source = df.where(F.col(f"`{key}`").isNotNull() & (F.octet_length(f"`{content}`") >= run)).select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{content}`").alias("_c"))
    every = checkpointed(source.mapInArrow(_passages(run, shingle), "_m long, _id long, _at int, _n int, _p binary"))
    # a minimizer's records show in the least and greatest key, so one that all files hold is settled by a combining aggregate
    recurring = every.groupBy("_m").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).where("a <> b").select("_m")
    places = every.join(recurring, "_m", "left_semi")
    # one record stands for all copies of a passage
    copies = places.groupBy("_m", "_p").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.min(F.struct("_id", "_at", "_n")).alias("_r"))
    wanted = copies.groupBy(F.col("_r._id").alias("_id")).agg(F.collect_list(F.struct(F.col("_m").alias("m"), F.col("_p").alias("p"), F.col("_r._at").alias("at"), F.col("_r._n").alias("n"), F.col("_low").alias("low"), F.col("_high").alias("high"))).alias("_w"))
    texts = wanted.join(source.dropDuplicates(["_id"]), "_id").mapInArrow(_fetch, "_m long, _p binary, _t binary, _low long, _high long")
    counts = copies.groupBy("_m").agg(F.count("*").alias("_copies")).where(F.col("_copies") > HOT_PASSAGES).select("_m", F.lit(True).alias("_hot"))
    routed = checkpointed(texts.join(counts, "_m", "left"))
    sharded = routed.where("_hot IS NULL").repartition(partitions_for(df, per_byte=3.0), "_m").sortWithinPartitions("_m")
    spans = sharded.mapInArrow(_confirm(run), "_m long, _p binary, _spans array<struct<a:int,b:int>>").select("_m", "_p", F.inline("_spans"))
    phrases = routed.where("_hot").mapInArrow(_phrases(run), "_m long, _p binary, _a int, _h binary, _low long, _high long")
    shared = phrases.groupBy("_h").agg(F.min("_low").alias("x"), F.max("_high").alias("y")).where("x <> y").select("_h")
    hot = phrases.join(shared, "_h", "left_semi").select("_m", "_p", F.col("_a").alias("a"), (F.col("_a") + run).cast("int").alias("b"))
    located = places.join(spans.unionByName(hot), ["_m", "_p"]).select("_id", (F.col("_at") + F.col("a")).alias("a"), (F.col("_at") + F.col("b")).alias("b")).distinct()
    return merged(located, key)


def merged(spans: DataFrame, key: str) -> DataFrame:
    """Spans [a, b) of each record joined where they meet or overlap."""
    by = Window.partitionBy("_id").orderBy("a", "b")
    reach = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    blocks = spans.withColumn("_new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0)).withColumn("_block", F.sum("_new").over(by))
    ends = blocks.groupBy("_id", "_block").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    total = F.sum(F.col("b") - F.col("a")).over(Window.partitionBy("_id"))
    return ends.select(F.col("_id").alias(key), (F.col("a") + 1).cast("int").alias("start_line"), F.col("b").cast("int").alias("end_line"), total.cast("int").alias("shared_lines"))
