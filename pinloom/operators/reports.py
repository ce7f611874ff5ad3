"""Checks and forms of reports: what makes one invalid, its bounds, its order, its canonical text, and stored snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinloom.functions.digests import git_blob_sha
from pinloom.operators.ranking import IDENTITY


def report_problems(matches: DataFrame, coverage: DataFrame) -> DataFrame:
    """(problem, n): what is wrong with a report, with how many rows show it; no row for a sound one.

    Identities must be unique, lines from 1 and in order, scores finite and not negative, kinds there; files indexed and excluded
    must sum to those eligible, the status must say whether any were excluded.
    """
    per = matches.groupBy(*IDENTITY).agg(F.count("*").alias("_n"), F.bool_or(F.isnan("score") | (F.col("score") < 0) | F.col("score").isNull() | (F.col("score") == float("inf"))).alias("_s"), F.bool_or(F.coalesce(F.size("matched_kinds"), F.lit(0)) < 1).alias("_k"))
    bad_lines = (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))
    counts = per.agg(F.count_if(F.col("_n") > 1).alias("duplicate_identity"), F.count_if("_s").alias("bad_score"), F.count_if("_k").alias("no_kinds"), F.count_if(bad_lines).alias("bad_lines"))
    whole = F.col("files_eligible") == F.col("files_indexed") + F.col("files_excluded")
    said = (F.col("status") == "complete_for_declared_universe") == (F.col("files_excluded") == 0)
    cover = coverage.agg(F.count_if(~whole).alias("coverage_sum"), F.count_if(~said).alias("coverage_status"))
    rows = lambda df, names: df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(n).cast("long").alias("n")) for n in names])))
    return rows(counts, ["bad_lines", "bad_score", "duplicate_identity", "no_kinds"]).unionByName(rows(cover, ["coverage_sum", "coverage_status"])).where("n > 0")


def bounds(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(bound, limit, observed, reached) for one row of counts: which limits of a search were reached."""
    entries = [F.struct(F.lit(n).alias("bound"), F.lit(v).cast("long").alias("limit"), F.col(n).cast("long").alias("observed"), (F.col(n) >= v).alias("reached")) for n, v in sorted(limits.items())]
    return counts.select(F.inline(F.array(*entries)))


def limited(df: DataFrame, order: Sequence[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first rows in order, and one row (limit, kept, dropped) that says what the limit cost."""
    kept = df.orderBy(*order).limit(limit)
    total = df.agg(F.count("*").alias("_n"))
    return kept, total.select(F.lit(limit).cast("long").alias("limit"), F.least(F.lit(limit), F.col("_n")).cast("long").alias("kept"), F.greatest(F.lit(0), F.col("_n") - limit).cast("long").alias("dropped"))


def out_of_order(df: DataFrame, by: Sequence[str], position: str, key: Sequence[str]) -> DataFrame:
    """Rows that don't come after the one before them: (by, position, state) with state ``duplicate`` or ``unsorted``."""
    window = Window.partitionBy(*by).orderBy(position)
    now, before = F.struct(*key), F.lag(F.struct(*key)).over(window)
    state = F.when(before == now, "duplicate").when(before > now, "unsorted")
    return df.withColumn("state", state).where("state IS NOT NULL").select(*by, position, "state")


def replays_differ(first: DataFrame, second: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys whose rows in two runs are not equal in all columns, or stand in one alone."""
    digest = lambda df, n: df.select(*key, F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary")).alias(n))
    return digest(first, "_a").join(digest(second, "_b"), list(key), "full_outer").where("NOT (_a <=> _b)").select(*key)


def canonical_json(columns: Sequence[str]) -> Column:
    """The row as JSON with its fields in text order, without blanks; null fields stay."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def export_snapshot(blobs: DataFrame, folder: str) -> DataFrame:
    """Writes pinned files (slug, commit_sha, path, content) and the digest of each pin: (slug, commit_sha, files, digest)."""
    blobs.select("slug", "commit_sha", "path", "content").distinct().write.mode("overwrite").parquet(f"{folder}/files")
    spark = blobs.sparkSession
    pin_digests(spark.read.parquet(f"{folder}/files")).write.mode("overwrite").parquet(f"{folder}/pins")
    return spark.read.parquet(f"{folder}/pins")


def pin_digests(files: DataFrame) -> DataFrame:
    """One row for each pin with an order-free digest of its (path, blob) pairs, so that no pin is gathered in one row."""
    sha = git_blob_sha(F.col("content"))
    hashes = [F.sum(F.xxhash64(F.lit(seed), "path", sha).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return files.groupBy("slug", "commit_sha").agg(F.count("*").alias("files"), F.concat_ws(":", *hashes).alias("digest"))


def import_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The exported files, if every pin's digest still holds; else nothing is imported and ValueError names how many pins differ."""
    files, pins = spark.read.parquet(f"{folder}/files"), spark.read.parquet(f"{folder}/pins")
    now = pin_digests(files).select("slug", "commit_sha", F.col("digest").alias("_d"))
    broken = pins.join(now, ["slug", "commit_sha"], "full_outer").where("NOT (digest <=> _d)").count()
    if broken:
        raise ValueError(f"{broken} pins differ from what was exported")
    return files


def pointer_lines(symbols: DataFrame) -> DataFrame:
    """A listing of symbols as Markdown, one line for each: (slug, position, text); positions count within a repository."""
    place = F.row_number().over(Window.partitionBy("slug").orderBy("path", "line", "qualified_name"))
    text = F.concat(F.lit("- ["), "qualified_name", F.lit("]("), "path", F.lit("#L"), F.col("line").cast("string"), F.lit(")"))
    return symbols.where("path IS NOT NULL AND line IS NOT NULL AND qualified_name IS NOT NULL").select("slug", place.alias("position"), text.alias("text"))


def deterministic_sample(files: DataFrame, by: Sequence[str], seed: str, max_files: int, max_bytes: int) -> DataFrame:
    """Of each tree the files that fill a budget greedily in the order of a hash of seed and path; files that don't fit are skipped.

    ``files`` has (by, path, size). What a tree takes depends on all it took before, so a tree's paths and sizes meet in one
    task, one Arrow batch after the other, while the taken ones are bounded by ``max_files``; files larger than the budget never
    get there. Columns: by, path, size, position.
    """
    hashed = files.where(F.col("size") <= max_bytes).select(*by, "path", F.col("size").cast("long").alias("size"), F.sha2(F.concat(F.lit(seed), F.lit("\u0000"), F.col("path")).cast("binary"), 256).alias("_h"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*by).schema), "path string", "size bigint", "position int"])

    def fill(pdf):
        pdf = pdf.sort_values(["_h", "path"])
        took, total, position = [], 0, 0
        positions = []
        for i, size in enumerate(pdf["size"]):
            if position >= max_files:
                break
            if total + size <= max_bytes:
                total, position = total + size, position + 1
                took.append(i)
                positions.append(position)
        out = pdf.iloc[took][[*by, "path", "size"]].copy()
        out["position"] = positions
        return out

    return hashed.groupBy(*by).applyInPandas(fill, schema)
