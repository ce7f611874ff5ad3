"""The trigram index: which blobs hold which three bytes, and which can match a query."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.operators.predicates import _c, _p
from pinloom.plans.search import Report, coverage, search, searched
from pinloom.plans.sizing import partitions_for, small_enough
from pinloom.plans.spec import Predicate, SearchSpec
from pinloom.sources.blobs import KEY


def trigrams(content: Column) -> Column:
    """The distinct windows of three bytes, in lower-case hex; none below three bytes."""
    n = F.octet_length(content)
    data = content.cast("binary")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.lower(F.hex(F.substring(data, i, F.lit(3)))))
    return F.when(n >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each content by its distinct trigrams, as numbers in order."""
    for batch in batches:
        codes = []
        for content in batch.column("content").to_pylist():
            b = np.frombuffer(content or b"", np.uint8).astype(np.int32)
            codes.append(np.unique((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) if len(b) > 2 else np.zeros(0, np.int32))
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        size = [(batch.column("size"), "size")] if "size" in batch.schema.names else []
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), *[c for c, _ in size]], names=[*KEY, "_grams", *[n for _, n in size]])


def index(blobs: DataFrame) -> DataFrame:
    """Rows (gram, key of the blob). Kept as rows: a common gram's list of blobs would not fit one.

    The windows of a blob are made in numpy, from whole Arrow batches; one row leaves Python for each blob.
    """
    source = blobs.select(*KEY, F.col("content").cast("binary").alias("content"))
    grams = source.mapInArrow(_codes, ", ".join(f"{c} string" for c in KEY) + ", _grams array<int>")
    return grams.select(*KEY, F.explode("_grams").alias("_code")).select(*KEY, F.lower(F.lpad(F.hex("_code"), 6, "0")).alias("gram"))


def postings(blobs: DataFrame) -> DataFrame:
    """How many blobs hold each gram."""
    return index(blobs).groupBy("gram").agg(F.count("*").alias("blobs"))


@dataclass(frozen=True)
class StoredIndex:
    """A written index: documents (doc, key, size), postings (bucket, code, doc) and what its manifest says."""

    folder: str
    documents: DataFrame
    postings: DataFrame
    manifest: dict


#: Folders that the postings are spread over by their code, so that a query reads only those of its grams.
BUCKETS = 64


def _set_digest(docs: DataFrame) -> DataFrame:
    """Count and digest of a set of documents, whatever their order: the sum of two hashes of each key."""
    hashed = docs.select(*[F.sum(F.xxhash64(F.lit(seed), *KEY, "size").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)], F.count("*").alias("documents"))
    return hashed


def write_index(blobs: DataFrame, folder: str) -> dict:
    """Writes the index of blobs below a folder and returns its manifest. Repeated keys count once.

    Each document's grams are made once and written with its number; documents and postings are read from there. The manifest is
    written last: a folder without one is no index. An existing index is replaced.
    """
    spark = blobs.sparkSession
    source = blobs.where("content IS NOT NULL").select(*KEY, F.col("content").cast("binary").alias("content"), "size")
    ddl = ", ".join(f"{c} string" for c in KEY) + ", _grams array<int>, size long"
    coded = source.mapInArrow(_codes, ddl).dropDuplicates(KEY).withColumn("doc", F.monotonically_increasing_id())
    coded.write.mode("overwrite").parquet(f"{folder}/grams")
    stored = spark.read.parquet(f"{folder}/grams")
    stored.select(*KEY, "size", "doc").write.mode("overwrite").parquet(f"{folder}/documents")
    rows = stored.select("doc", F.explode("_grams").alias("code")).withColumn("bucket", F.col("code") % BUCKETS)
    rows.repartition(partitions_for(blobs, per_byte=2.0), "bucket").sortWithinPartitions("bucket", "code").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    count = stored.agg(F.coalesce(F.sum(F.size("_grams")), F.lit(0)).cast("long").alias("postings"))
    manifest = _set_digest(spark.read.parquet(f"{folder}/documents")).join(F.broadcast(count)).withColumn("version", F.lit("trigrams-1"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return open_index(spark, folder).manifest


def open_index(spark: SparkSession, folder: str, blobs: DataFrame | None = None) -> StoredIndex:
    """Opens a written index. It is refused if its documents are not those its manifest was made of, or, with ``blobs``, not those."""
    docs, postings = spark.read.parquet(f"{folder}/documents"), spark.read.parquet(f"{folder}/postings")
    [row] = spark.read.parquet(f"{folder}/manifest").collect()
    for other in [docs] + ([blobs.where("content IS NOT NULL").select(*KEY, "size").distinct()] if blobs is not None else []):
        [now] = _set_digest(other).collect()
        if (now.h1, now.h2, now.documents) != (row.h1, row.h2, row.documents):
            raise ValueError("the index was made of other documents")
    return StoredIndex(folder, docs, postings, row.asDict())


def stored_candidates(index: StoredIndex, spec: SearchSpec) -> DataFrame | None:
    """As ``candidates``, from a written index: only the buckets of the wanted grams are read."""
    wanted = sorted({int(g, 16) for p in spec.content_must for g in needed_grams(p)})
    if not wanted:
        return None
    hits = index.postings.where(F.col("bucket").isin(sorted({c % BUCKETS for c in wanted})) & F.col("code").isin(wanted))
    return hits.groupBy("doc").agg(F.count("*").alias("_n")).where(F.col("_n") == len(wanted)).join(index.documents, "doc").select(*KEY)


def literal_runs(pattern: str) -> list[str]:
    """The texts of at least three bytes that every match of a pattern holds; none where that can't be told."""
    try:
        parsed = _p.parse(pattern)
    except re.error:
        return []
    if parsed.state.flags & re.IGNORECASE:
        return []
    runs: list[str] = []
    now: list[str] = []

    def cut() -> None:
        run = "".join(now)
        now.clear()
        if len(run.encode("utf-8", "replace")) >= 3 and "�" not in run:
            runs.append(run)

    def walk(items) -> None:
        for op, arg in items:
            if op is _c.LITERAL:
                now.append(chr(arg))
            elif op is _c.SUBPATTERN and not (arg[1] or arg[2]):
                walk(arg[3])
            elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
                cut()
            elif op is _c.AT:
                continue
            else:
                cut()

    walk(parsed)
    cut()
    return runs


def needed_grams(p: Predicate) -> set[str]:
    runs = [p.value] if p.kind == "exact_text" else literal_runs(p.value) if p.kind == "regex" else []
    out: set[str] = set()
    for run in runs:
        data = run.encode()
        out |= {data[i : i + 3].hex() for i in range(len(data) - 2)}
    return out


def candidates(grams: DataFrame, spec: SearchSpec) -> DataFrame | None:
    """The blobs that hold all grams of all musts; null if the musts need none, so that everything must be scanned."""
    wanted = sorted(set().union(*(needed_grams(p) for p in spec.content_must)))
    if not wanted:
        return None
    return grams.where(F.col("gram").isin(*wanted)).groupBy(*KEY).agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(wanted)).drop("_n")


def indexed_search(blobs: DataFrame, grams: DataFrame | StoredIndex, spec: SearchSpec) -> Report:
    """The same result as ``search``, reading only candidates where the index can tell them.

    Languages whose text is masked before matching are scanned in full, since a blank in masked text need not be one in the
    bytes. Coverage counts all searchable blobs: those that are no candidates are proven not to match.
    """
    chosen = stored_candidates(grams, spec) if isinstance(grams, StoredIndex) else candidates(grams, spec)
    if chosen is None:
        return search(blobs, spec)
    chosen = F.broadcast(chosen) if small_enough(chosen) else chosen
    # a path holds one blob, so the others' SHAs need not be made
    few = blobs.join(chosen.select(*KEY[:3]), KEY[:3], "left_semi")
    found = search(few, spec, masks=False).matches.unionByName(search(blobs, spec, masks=True).matches)
    return Report(found, coverage(searched(blobs, spec)), spec.digest())
