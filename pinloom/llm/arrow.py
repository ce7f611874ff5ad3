"""Small helpers for operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa


def batches_of(rows: Iterable[Sequence], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows, as tuples in the schema's order, as Arrow batches of at most ``size`` rows."""
    held: list[Sequence] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[Sequence], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of a batch as tuples of the named columns."""
    return zip(*(batch.column(n).to_pylist() for n in names))
