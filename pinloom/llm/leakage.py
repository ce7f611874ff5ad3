"""Evaluation texts that leak into training text, by an FM-index per shard of the training texts.

The test items are the stated query set. Their phrases of 13 words, or the whole of shorter items, are searched backward in
every shard's index; the occurrences are located and attributed to documents and items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinloom.llm.arrow import batches_of
from pinloom.llm.fm_index import FMIndex

WORD = re.compile(r"[^\W_]+")
PHRASE = 13
#: Words of one index; a longer partition gives several.
SHARD_WORDS = 6_000_000
#: Bytes of test items that are searched for at once; more are searched for in blocks.
BLOCK_BYTES = 8 << 20
#: Located occurrences are handled in portions of this many.
PORTION = 1 << 20


def words(text: str) -> list[str]:
    """Runs of letters or digits, lower-cased; an underscore is neither."""
    if text.isascii():
        return WORD.findall(text.lower())
    return [w.lower() for w in WORD.findall(text)]


@dataclass
class Phrases:
    """The phrases of the test items as rows of symbols, aligned to the right, with the items each belongs to."""

    vocabulary: dict[str, int]
    symbols: np.ndarray
    lengths: np.ndarray
    item_start: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]], phrase: int) -> Phrases:
        vocabulary: dict[str, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in rows:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text or ""))
            for k in range(max(1, len(ids) - phrase + 1)):
                if part := ids[k : k + phrase]:
                    found.setdefault(part, set()).add(item)
        symbols = np.zeros((len(found), phrase), dtype=np.int64)
        for i, part in enumerate(found):
            symbols[i, phrase - len(part) :] = part
        counts = [len(x) for x in found.values()]
        return cls(vocabulary, symbols, np.array([len(x) for x in found], dtype=np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.array([i for x in found.values() for i in sorted(x)], dtype=np.int64))


def kept_words(found: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a text's words, and which words they stand for.

    A run of words that no item holds can't be crossed by any phrase and becomes one separator.
    """
    get = vocabulary.get
    ids = np.fromiter((get(w, 0) for w in found), np.int32, len(found))
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    unknown = ids == 0
    kept = np.flatnonzero(~(unknown & np.concatenate([[True], unknown[:-1]])))
    return ids[kept], kept


def encode(texts: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each ended by a separator, and where each text begins."""
    parts: list[np.ndarray] = []
    starts = np.empty(len(texts) + 1, dtype=np.int64)
    at = 0
    for i, text in enumerate(texts):
        starts[i] = at
        ids, _ = kept_words(words(text), vocabulary)
        parts += [ids, np.zeros(1, np.int32)]
        at += len(ids) + 1
    starts[-1] = at
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), starts


def search_shard(texts: list[str], phrases: Phrases, places: bool = False) -> np.ndarray:
    """The distinct pairs (text, phrase) that occur in a shard, as two rows; with ``places`` every occurrence, its place among the
    text's symbols in a third row."""
    symbols, starts = encode(texts, phrases.vocabulary)
    if not len(phrases.lengths) or not len(symbols):
        return np.zeros((2 + places, 0), np.int64)
    index = FMIndex(symbols, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.symbols, phrases.lengths)
    hits = np.flatnonzero(high > low)
    sizes = (high - low)[hits]
    out: list[np.ndarray] = []
    begin = 0
    while begin < len(hits):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), PORTION)))
        phrase = np.repeat(hits[begin:end], sizes[begin:end])
        first = np.cumsum(sizes[begin:end]) - sizes[begin:end]
        rows = np.arange(len(phrase)) - np.repeat(first, sizes[begin:end]) + np.repeat(low[hits[begin:end]], sizes[begin:end])
        at = index.locate(rows)
        text = np.searchsorted(starts, at, side="right") - 1
        out.append(np.stack([text, phrase, at - starts[text]]) if places else np.unique(np.stack([text, phrase]), axis=1))
        begin = end
    return np.concatenate(out, axis=1) if out else np.zeros((2 + places, 0), np.int64)


def removal_spans(text: str, vocabulary: dict[str, int], places: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters [a, b) of located phrases: ``places`` count the text's symbols, ``lengths`` the phrases' words."""
    found = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    _, kept = kept_words([w for w, _, _ in found], vocabulary)
    begins, ends = np.array([a for _, a, _ in found]), np.array([b for _, _, b in found])
    # a phrase's words are all known, so they stand side by side in the text too
    first = kept[places]
    return begins[first], ends[first + lengths - 1]


def merged_spans(spans: list[tuple], items_of) -> Iterator[tuple[int, int, list[int]]]:
    """Sorted spans (a, b, phrase) joined where they meet or overlap, each with the items of its phrases."""
    begin, end, held = -1, -1, set()
    for a, b, p in spans:
        if a > end:
            if held:
                yield begin, end, sorted(held)
            begin, held = a, set()
        end = max(end, b)
        held.update(items_of(p))
    if held:
        yield begin, end, sorted(held)


FOUND = pa.schema([("_doc", pa.int64()), ("_item", pa.int64())])
SPANS = pa.schema([("_doc", pa.int64()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("items", pa.list_(pa.int64()))])


def _search(df: DataFrame, phrases: Phrases, key: str, text: str, spans: bool) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(phrases)

    def shard(ids: list[int], texts: list[str]) -> Iterator[tuple]:
        own = held.value
        if not spans:
            at, phrase = search_shard(texts, own)
            for t, p in zip(at.tolist(), phrase.tolist()):
                for k in range(own.item_start[p], own.item_start[p + 1]):
                    yield ids[t], int(own.items[k])
            return
        at, phrase, place = search_shard(texts, own, places=True)
        order = np.argsort(at, kind="stable")
        at, phrase, place = at[order], phrase[order], place[order]
        for a, b in zip(np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else [], np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at))):
            t, ps = int(at[a]), phrase[a:b]
            starts, ends = removal_spans(texts[t], own.vocabulary, place[a:b], own.lengths[ps])
            spans_ = sorted(zip(starts.tolist(), ends.tolist(), ps.tolist()))
            yield from ((ids[t], x, y, z) for x, y, z in merged_spans(spans_, lambda p: own.items[own.item_start[p] : own.item_start[p + 1]].tolist()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids: list[int] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column("_id").to_pylist(), batch.column("_t").to_pylist()):
                ids.append(i)
                texts.append(t.decode("utf-8", "replace"))
                size += len(t)
                if size > SHARD_WORDS * 6:
                    yield from shard(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from shard(ids, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), SPANS if spans else FOUND)

    ddl = "_doc long, start_char int, end_char int, items array<long>" if spans else "_doc long, _item long"
    source = df.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("binary").alias("_t"))
    return source.mapInArrow(run, ddl)


def _blocks(items: DataFrame, item_key: str, text: str, phrase: int) -> Iterator[Phrases]:
    """The test items in blocks of a bounded size; each is gathered by itself, as the stated query set."""
    size = items.agg(F.sum(F.octet_length(f"`{text}`")).alias("size")).collect()[0]["size"]
    count = int((size or 0) / BLOCK_BYTES) + 1
    wanted = items.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item_key}`").cast("long"), F.col(f"`{text}`"))
    for k in range(count):
        part = wanted if count == 1 else wanted.where(F.pmod(F.xxhash64(F.col(f"`{item_key}`")), F.lit(count)) == k)
        yield Phrases.of([tuple(r) for r in part.collect()], phrase)


def leaked_items(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", phrase: int = PHRASE) -> DataFrame:
    """The documents that hold passages of test items, and the items: distinct rows (key, item_key).

    A document is a case for an item if ``phrase`` consecutive words of the item, or all words of an item with fewer, occur
    consecutively in its text. Null texts and texts without words give no row, on either side.
    """
    out = None
    for phrases in _blocks(items, item_key, item_text, phrase):
        part = _search(df, phrases, key, text, spans=False)
        out = part if out is None else out.unionByName(part)
    return out.distinct().select(F.col("_doc").alias(key), F.col("_item").alias(item_key))


def leaked_spans(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", phrase: int = PHRASE) -> DataFrame:
    """The spans to remove: (key, start_char, end_char, items), joined within a document where they meet or overlap; ``items`` are
    those whose passages lie in the span. Repeated rows count once; nulls as in ``leaked_items``.

    Of several blocks of test items the spans are joined again by document, whose own spans are all that one task gathers.
    """
    parts = [_search(df, phrases, key, text, spans=True) for phrases in _blocks(items, item_key, item_text, phrase)]
    if len(parts) == 1:
        return parts[0].distinct().withColumnRenamed("_doc", key)
    by = Window.partitionBy("_doc").orderBy("start_char", "end_char")
    reach = F.max("end_char").over(by.rowsBetween(Window.unboundedPreceding, -1))
    every = reduce(DataFrame.unionByName, parts).distinct()
    blocks = every.withColumn("_new", F.when(F.col("start_char") <= reach, 0).otherwise(1)).withColumn("_block", F.sum("_new").over(by))
    joined = blocks.groupBy("_doc", "_block").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return joined.drop("_block").withColumnRenamed("_doc", key)
