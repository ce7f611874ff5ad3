"""Scoped exhaustive search: a typed query compiled to columns over blobs.

A blob's lines stay in its row: the predicates run as higher-order functions over the array of lines, so the whole search,
file-level exclusions included, is one pass without a shuffle. Only the order of the result needs one.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pinloom.operators import predicates as P
from pinloom.plans.spec import Predicate, SearchSpec
from pinloom.sources.blobs import KEY, lines_of

#: Larger blobs are excluded where a query needs the file as a whole, and where a line is longer than the second number.
LARGE, LONG_LINE = 2 << 20, 512 << 10


@dataclass(frozen=True)
class Report:
    """Matches without order, and one row that tells what was and was not searched."""

    matches: DataFrame
    coverage: DataFrame
    spec_digest: str


def _python_hits(pattern: str):
    @F.pandas_udf("array<int>")
    def hits(content: pd.Series) -> pd.Series:
        search = re.compile(pattern).search
        return content.map(lambda t: [i for i, line in enumerate(t.split("\n")) if search(line)] if isinstance(t, str) else [])

    return hits


@F.pandas_udf(StringType())
def mask_text(content: pd.Series) -> pd.Series:
    return content.map(lambda t: P.masked(t) if isinstance(t, str) else t)


def eligible(blobs: DataFrame, spec: SearchSpec) -> DataFrame:
    """The blobs in scope that have an adapter of the required language and, if paths are asked for, any such path."""
    out = blobs
    if spec.scopes is not None:
        wanted = None
        for s in dict.fromkeys(spec.scopes):  # a scope named twice counts once
            hit = (F.col("slug") == s.slug) & (F.col("commit_sha") == s.commit_sha)
            wanted = hit if wanted is None else wanted | hit
        out = out.where(wanted) if wanted is not None else out
    out = out.withColumn("language", P.language_of(F.col("path"))).where("language IS NOT NULL")
    if spec.languages:
        out = out.where(F.col("language") == spec.languages[0])
    if spec.paths:
        out = out.where(P.any_of([P.path_predicate(p, F.col("path")) for p in spec.paths]))
    return out


def _tests(items: tuple[Predicate, ...], languages: tuple[str, ...]) -> list:
    """For each predicate a function of (line, language, place of the line) to a boolean column."""
    out = []
    for p in items:
        by = {language: P.line_predicate(p, language) for language in languages}
        if any(f is None for f in by.values()):
            if p.kind == "signature":
                raise ValueError("a signature pattern must be one that Spark can run")
            out.append(("python", p))
        elif p.kind in ("exact_text", "regex", "identifier", "token_sequence"):
            out.append(("same", by[languages[0]]))
        else:
            out.append(("each", by))
    return out


def _hit(test, line: Column, place: Column, k: int) -> Column:
    kind, f = test
    if kind == "python":
        return F.array_contains(F.col(f"_python{k}"), place)
    if kind == "same":
        return f(line)
    out = F.lit(False)
    for language, g in f.items():
        out = F.when(F.col("language") == language, g(line)).otherwise(out)
    return out


def _branch(blobs: DataFrame, spec: SearchSpec, languages: tuple[str, ...], masks: bool) -> DataFrame:
    must, should, must_not = spec.content_must, spec.content_should, spec.content_must_not
    every = [*must, *should, *must_not]
    tests = _tests(tuple(every), languages)
    out = blobs.where(F.col("language").isin(*languages))
    if must and not masks:
        # a line a predicate hits holds its text, so a file without the text of every must has no match
        for text in dict.fromkeys(t for p in must if (t := P.needed_text(p))):
            out = out.where(F.col("content").contains(text))
    if masks:
        out = out.withColumn("content", mask_text(F.col("content")))
    for k, (kind, p) in enumerate(tests):
        if kind == "python":
            out = out.withColumn(f"_python{k}", _python_hits(p.value)(F.col("content")))
    rows = F.transform(lines_of(F.col("content")), lambda line, i: F.struct((i + 1).alias("n"), F.array(*[F.coalesce(_hit(t, line, i, k), F.lit(False)) for k, t in enumerate(tests)]).alias("h")))
    out = out.withColumn("_hits", F.filter(rows, lambda x: F.exists(x["h"], lambda b: b)))

    def in_file(k: int) -> Column:
        return F.exists("_hits", lambda x: x["h"][k])

    first_should, first_not = len(must), len(must) + len(should)
    nots = range(first_not, len(every))
    for k in nots if not spec.must_not_lines or spec.whole_file_must else ():
        out = out.where(~in_file(k))
    musts, shoulds = range(len(must)), range(first_should, first_not)
    whole = spec.whole_file_must and bool(must)
    if whole:
        for k in musts:
            out = out.where(in_file(k))

    def every_of(h: Column, places) -> Column:
        test = F.lit(True)
        for k in places:
            test = test & h[k]
        return test

    kinds = [p.kind for p in every]
    if must:
        chosen = F.filter("_hits", lambda x: P.any_of([x["h"][k] for k in musts]) if whole else every_of(x["h"], musts))
    elif should:
        chosen = F.filter("_hits", lambda x: every_of(x["h"], shoulds))
    else:
        chosen = F.filter("_hits", lambda x: F.lit(False))
    if spec.must_not_lines and len(nots):
        chosen = F.filter(chosen, lambda x: ~P.any_of([x["h"][k] for k in nots]))
    out = out.select(*KEY, *[in_file(k).alias(f"_f{k}") for k in shoulds], F.explode(chosen).alias("_x"))
    h = F.col("_x.h")
    if spec.whole_file_must:
        boost = F.lit(0)
        for k in shoulds:
            boost = boost + F.when(F.col(f"_f{k}"), 1).otherwise(0)
        found = [F.when(h[k], F.lit(kinds[k])) for k in musts] + [F.when(F.col(f"_f{k}"), F.lit(kinds[k])) for k in shoulds]
    else:
        both = every_of(h, shoulds)
        distinct = len({kinds[k] for k in shoulds})
        boost = F.when(both, distinct).otherwise(0) if should else F.lit(0)
        found = [F.lit(kinds[k]) for k in musts] + [F.when(both, F.lit(kinds[k])) for k in shoulds]
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    return out.select(*KEY, F.col("_x.n").alias("start_line"), F.col("_x.n").alias("end_line"), (F.lit(len(must)) + boost).cast("double").alias("score"), names.alias("matched_kinds"))


def searched(blobs: DataFrame, spec: SearchSpec) -> DataFrame:
    """The eligible blobs with the reason why one can't be searched, null for those that are."""
    longest = F.array_max(F.transform(F.split("content", "\n", -1), lambda x: F.octet_length(x)))
    reason = F.when(F.col("content").isNull(), "fetch_failed").when((F.col("size") > LARGE) & F.lit(spec.whole_file_must), "parser_unavailable")
    return eligible(blobs, spec).withColumn("excluded", reason.when((F.col("size") > LARGE) & (longest > LONG_LINE), "parser_unavailable"))


def search(blobs: DataFrame, spec: SearchSpec, masks: bool | None = None) -> Report:
    """Runs a query over blobs (slug, commit_sha, path, blob_sha, size, content).

    Matches: the blob's key, start_line, end_line, score, matched_kinds; one row for each matching line. A blob that can't be
    searched is excluded and makes the report partial. Blobs without a path are not eligible. Repeated blobs give repeated
    matches, which ``dedup_matches`` settles; other columns are ignored. ``masks`` restricts the search to languages whose text is
    masked, or to the others.
    """
    files = searched(blobs, spec)
    ready = files.where("excluded IS NULL")
    languages = spec.languages or tuple(name for name, _ in P.SUFFIXES)
    sides = {False: tuple(x for x in languages if x not in P.MASKED), True: tuple(x for x in languages if x in P.MASKED)}
    parts = [_branch(ready, spec, names, m) for m, names in sides.items() if names and masks in (None, m)]
    matches = parts[0] if parts else _branch(ready.where("false"), spec, languages, False)
    for p in parts[1:]:
        matches = matches.unionByName(p)
    return Report(matches, coverage(files), spec.digest())


def coverage(files: DataFrame) -> DataFrame:
    """One row: eligible, indexed and excluded files, the exclusions by reason, and the status."""
    counts = files.groupBy("excluded").agg(F.count("*").alias("n"))
    eligible_count, excluded = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("excluded").isNotNull(), F.col("n"))), F.lit(0))
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("excluded").isNotNull(), F.struct("excluded", "n")))))
    return counts.agg(eligible_count.alias("files_eligible"), (eligible_count - excluded).alias("files_indexed"), excluded.alias("files_excluded"), reasons.alias("exclusions")).withColumn(
        "status", F.when(F.col("files_excluded") == 0, "complete_for_declared_universe").otherwise("partial")
    )


def search_lines(lines: DataFrame, spec: SearchSpec) -> DataFrame:
    """The matches of a query over rows of lines (key, line_no, line), so that no blob need fit a row.

    Musts, and excluded lines, are tested line by line in a narrow pass; a file-level exclusion or boost takes one aggregate over
    keys of lines that hit. Languages whose text is masked before matching can't be told line by line and are left out, as are
    whole-file musts, which raise ValueError, and patterns that only Python can run.
    """
    if spec.whole_file_must:
        raise ValueError("a whole-file search needs whole files")
    plain = tuple(x for x, _ in P.SUFFIXES if x not in P.MASKED)
    every = [*spec.content_must, *spec.content_should, *spec.content_must_not]
    tests = _tests(tuple(every), plain)
    if any(kind == "python" for kind, _ in tests):
        raise ValueError("a pattern over lines must be one that Spark can run")
    files = eligible(lines, spec).where(F.col("language").isin(*plain))
    hits = files.select(*KEY, F.col("line_no").alias("start_line"), *[F.coalesce(_hit(t, F.col("line"), F.col("line_no"), k), F.lit(False)).alias(f"_h{k}") for k, t in enumerate(tests)])
    musts, shoulds, nots = range(len(spec.content_must)), range(len(spec.content_must), len(spec.content_must) + len(spec.content_should)), range(len(spec.content_must) + len(spec.content_should), len(every))
    every_of = lambda ks: functools.reduce(lambda a, b: a & b, [F.col(f"_h{k}") for k in ks], F.lit(True))
    found = hits.where(every_of(musts if spec.content_must else shoulds))
    if nots and spec.must_not_lines:
        found = found.where(~P.any_of([F.col(f"_h{k}") for k in nots]))
    elif nots:
        found = found.join(hits.where(P.any_of([F.col(f"_h{k}") for k in nots])).select(*KEY).distinct(), KEY, "left_anti")
    kinds = [p.kind for p in every]
    boost = F.when(every_of(shoulds), len({kinds[k] for k in shoulds})).otherwise(0) if shoulds else F.lit(0)
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.lit(kinds[k]) for k in musts], *[F.when(every_of(shoulds), F.lit(kinds[k])) for k in shoulds]))))
    return found.select(*KEY, "start_line", F.col("start_line").alias("end_line"), (F.lit(len(spec.content_must)) + boost).cast("double").alias("score"), names.alias("matched_kinds"))


def run_benchmark(blobs: DataFrame, tasks: list[tuple[str, SearchSpec, str]], k: int = 10) -> DataFrame:
    """(task, identity, rank): the first ``k`` results of each task in their total order. A task's query must have the digest it is
    stated with. Tasks are few and stated; the results of all are ranked at once, each partition keeping its own first ``k``."""
    parts = []
    for name, spec, digest in sorted(tasks, key=lambda t: t[0]):
        if spec.digest() != digest:
            raise ValueError(f"the query of {name} is another one")
        parts.append(search(blobs, spec).matches.select(F.lit(name).alias("task"), *KEY, "start_line", "end_line", "score"))
    order = Window.partitionBy("task").orderBy(F.col("score").desc(), *KEY, "start_line", "end_line")
    ranked = functools.reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("task", *KEY, "start_line", "end_line", F.col("rank").cast("long").alias("rank"))
