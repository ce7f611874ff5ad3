"""Splitting oversized texts at natural boundaries, by dynamic programming.

Sizes are tokens of the byte tokenizer, so positions are bytes. Every place between two characters may be a cut; its penalty
tells how natural it is. Among the cuts the program minimises the sum of penalties and of squared deviations from equal
sizes, where no piece, with the overlap it takes over from the piece before, exceeds the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinloom.llm.arrow import batches_of, columns

LIMIT, OVERLAP = 8192, 128
#: Of the cuts within so many bytes only the most natural one is kept, the last of equals; keeps the program linear.
GRAIN = 32
PARAGRAPH, LINE, SENTENCE, WORD, NONE = 0.0, 0.05, 0.1, 0.4, 3.0
#: Weight of a piece's squared relative deviation from the ideal size.
BALANCE = 0.5


def cut_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may stand before the byte, ascending, and their penalties."""
    b = np.frombuffer(data, np.uint8)
    penalty = np.full(len(b), NONE)
    penalty[(b & 0xC0) == 0x80] = np.inf  # within a character
    before, second = b[:-1], np.concatenate([[0], b[:-2]])
    space, line = (before == 32) | (before == 9), before == 10
    end = np.isin(second, np.frombuffer(b".!?:;", np.uint8))
    inner = penalty[1:]
    inner[space] = WORD
    inner[space & end] = SENTENCE
    inner[line] = LINE
    inner[line & ((second == 10) | (second == 13))] = PARAGRAPH
    penalty[0] = np.inf
    # the best of each grain: sort by grain, penalty, later first
    places = np.flatnonzero(np.isfinite(penalty))
    grain = places // GRAIN
    order = np.lexsort((-places, penalty[places], grain))
    first = np.ones(len(order), bool)
    first[1:] = grain[order][1:] != grain[order][:-1]
    kept = np.sort(places[order[first]])
    return kept, penalty[kept]


def overlap_start(data: bytes, cut: int, overlap: int) -> int:
    """Where the piece after ``cut`` begins: ``overlap`` bytes earlier, moved back to the beginning of a character."""
    start = max(0, cut - overlap)
    while start > 0 and data[start] & 0xC0 == 0x80:
        start -= 1
    return start


def split(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The pieces (start, end) of a text of UTF-8 bytes; one piece if it is no longer than the limit."""
    n = len(data)
    if n <= limit:
        return [(0, n)]
    places, penalties = cut_places(data)
    places, penalties = np.append(places, n), np.append(penalties, 0.0)
    room = limit - overlap - 3  # an overlap may grow by the rest of a character
    count = 1 + -(-(n - limit) // room)
    ideal = n / count
    cost = np.empty(len(places) + 1)
    back = np.zeros(len(places) + 1, dtype=np.int64)
    at = np.concatenate([[0], places])
    cost[0] = 0.0
    for j in range(1, len(at)):
        low = int(np.searchsorted(at, at[j] - room))
        if at[j] <= limit:
            low = 0  # the first piece takes over nothing
        sizes = (at[j] - at[low:j] - ideal) / ideal
        total = cost[low:j] + BALANCE * sizes * sizes
        best = int(np.argmin(total))
        cost[j] = total[best] + penalties[j - 1]
        back[j] = low + best
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(int(at[j]))
        j = int(back[j])
    out, previous = [], 0
    for cut in reversed(cuts):
        out.append((overlap_start(data, previous, overlap) if previous else 0, cut))
        previous = cut
    return out


PIECES = pa.schema(
    [("_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("overlap", pa.int32()), ("piece", pa.string())]
)
PIECES_DDL = "_id long, piece_no int, n_pieces int, start_token long, end_token long, overlap int, piece string"


def split_texts(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """The pieces of the texts of more than ``limit`` tokens; texts within the limit need no cut and give no row.

    Columns: ``key``, piece_no (from 0), n_pieces, start_token, end_token, overlap (tokens shared with the piece before),
    piece. Cuts stand at natural boundaries where there are any, else between characters. Null and empty texts give no row,
    repeated rows count once, other columns are ignored.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("the overlap must lie between 0 and half the limit")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, data in columns(batch, "_id", "_t"):
                pieces = split(data, limit, overlap)
                end = 0
                for k, (a, b) in enumerate(pieces):
                    yield i, k, len(pieces), a, b, end - a, data[a:b].decode("utf-8", "replace") if with_text else None
                    end = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), PIECES, 2_000)

    long = df.where(F.octet_length(f"`{text}`") > limit).select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("binary").alias("_t"))
    return long.mapInArrow(run, PIECES_DDL).distinct().withColumnRenamed("_id", key)
