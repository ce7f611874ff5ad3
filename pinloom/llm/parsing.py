"""Source files that do not parse, by packrat parsing-expression grammars that must consume the whole file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinloom.llm.arrow import batches_of, columns
from pinloom.llm.grammars import go, javascript, json_toml, python, rust
from pinloom.llm.peg import Tokens

#: The language that a path claims, by its ending.
LANGUAGES = {".py": "python", ".js": "javascript", ".go": "go", ".rs": "rust", ".json": "json", ".toml": "toml"}
SOURCE = ("python", "javascript", "go", "rust")
_MARKER = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?: |\r?$|$)", re.M)


def language_of(path: Column, languages: tuple[str, ...] = tuple(LANGUAGES.values())) -> Column:
    """The language a path claims, null for others; endings count as spelt."""
    out = F.lit(None).cast("string")
    for ending, language in LANGUAGES.items():
        if language in languages:
            out = F.when(path.endswith(ending), F.lit(language)).otherwise(out)
    return out


@dataclass
class Parsed:
    """What a grammar said about a file. ``place`` is the character where no alternative went further."""

    valid: bool
    text: str = ""
    tokens: Tokens = field(default_factory=Tokens)
    marks: set[tuple[str, int]] = field(default_factory=set)
    place: int = 0
    cause: str = ""


def decoded(language: str, data: bytes) -> str | None:
    """The text of a file, or null if its bytes are none. Source files may begin with a byte order mark."""
    if language == "python":
        return python.decode(data)
    if language in SOURCE and data.startswith(b"\xef\xbb\xbf"):
        data = data[3:]
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def tokenized(language: str, text: str) -> tuple[Tokens, dict | None]:
    if language == "javascript":
        return javascript.lex(text)
    lexers = {"python": python.lex, "go": go.lex, "rust": rust.lex, "json": json_toml.lex_json, "toml": json_toml.lex_toml}
    return lexers[language](text), None


_GRAMMARS = {"python": python.GRAMMAR, "javascript": javascript.GRAMMAR, "go": go.GRAMMAR, "rust": rust.GRAMMAR, "json": json_toml.JSON, "toml": json_toml.TOML}


@dataclass
class Lexed:
    """A file's text and tokens, before it is parsed."""

    text: str
    tokens: Tokens
    arrows: dict | None = None


def lexed(language: str, data: bytes) -> Lexed | None:
    """The tokens of a file; null if its bytes are no text, or nested too deeply for the lexer."""
    text = decoded(language, data)
    if text is None:
        return None
    try:
        return Lexed(text, *tokenized(language, text))
    except RecursionError:
        return None


def accepted(language: str, file: Lexed) -> bool:
    """Whether a source language's grammar takes all of a file's tokens."""
    try:
        return _GRAMMARS[language].accepts(file.tokens, file.arrows)
    except RecursionError:
        return False


def parse(language: str, data: bytes) -> Parsed:
    """Parses a file of a language; a file nested too deeply for the parser doesn't parse, with the cause ``nesting``."""
    text = decoded(language, data)
    if text is None:
        return Parsed(False, cause="encoding")
    try:
        tokens, arrows = tokenized(language, text)
        valid, furthest, marks = _GRAMMARS[language].parse(tokens, arrows)
        at = json_toml.toml_conflict(tokens) if valid and language == "toml" else -1
    except RecursionError:
        return Parsed(False, text, cause="nesting")
    if valid:
        if at >= 0:
            return Parsed(False, text, tokens, cause="value" if tokens.kinds[at] == "SCALAR" else "duplicate", place=tokens.offsets[at])
        return Parsed(True, text, tokens, marks)
    place = tokens.offsets[furthest]
    return Parsed(False, text, tokens, place=place, cause=cause_of(language, text, tokens, furthest, place))


def cause_of(language: str, text: str, tokens: Tokens, furthest: int, place: int) -> str:
    """merge_conflict, other_language, truncated, lexical or syntax, the first that fits."""
    line = text.rfind("\n", 0, place) + 1
    if _MARKER.match(text, line) or _MARKER.match(text, place):
        return "merge_conflict"
    if language in SOURCE and text.strip():
        for other in SOURCE:
            if other != language and (other != "python" or len(text.split()) > 3):
                try:
                    its, arrows = tokenized(other, text)
                    if _GRAMMARS[other].parse(its, arrows)[0]:
                        return "other_language"
                except RecursionError:
                    pass
    kind = tokens.kinds[furthest]
    if kind == "$" or (kind == "BAD" and tokens.problem in ("string", "comment", "bracket", "continuation") and place >= len(text.rstrip()) - 1):
        return "truncated"
    return f"lexical_{tokens.problem}" if kind == "BAD" else "syntax"


def spread(df: DataFrame, key: str, per_core: int = 3) -> DataFrame:
    """``df``, shuffled by key only if it is read in too few partitions to keep the cores busy with costly rows."""
    context = df.sparkSession.sparkContext
    wanted = per_core * context.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= wanted else df.repartition(wanted, key)


REPORT = pa.schema([("_id", pa.int64()), ("slug", pa.string()), ("language", pa.string()), ("valid", pa.bool_()), ("line", pa.int32()), ("cause", pa.string()), ("found", pa.string())])
REPORT_DDL = "_id long, slug string, language string, valid boolean, line int, cause string, found string"


def parse_files(df: DataFrame, key: str = "file_id", path: str = "path", content: str = "content", slug: str = "slug") -> DataFrame:
    """A row for each file whose path claims a language that has a grammar.

    Columns: ``key``, slug, language, valid, line (of the furthest failure, from 1), cause (merge_conflict, other_language,
    truncated, encoding, nesting, duplicate, value, lexical_..., syntax) and found (the token there). Repeated rows count once. Rows
    with null content or path give none; an empty file is parsed like any other. Other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, s, language, data in columns(batch, "_id", "_s", "_l", "_c"):
                out = parse(language, data)
                if out.valid:
                    yield i, s, language, True, None, None, None
                else:
                    at = out.place
                    yield i, s, language, False, out.text.count("\n", 0, at) + 1, out.cause, out.text[at : at + 20]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), REPORT)

    source = df.select(
        F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{slug}`").alias("_s"), language_of(F.col(f"`{path}`")).alias("_l"), F.col(f"`{content}`").alias("_c")
    ).where("_l IS NOT NULL AND _c IS NOT NULL")
    return spread(source, "_id").mapInArrow(run, REPORT_DDL).distinct().withColumnRenamed("_id", key)


def failure_rates(report: DataFrame) -> DataFrame:
    """Per repository and language: files, those that do not parse, their rate, and how many by each cause."""
    causes = F.map_from_entries(F.sort_array(F.collect_list(F.struct("cause", "n"))))
    by_cause = report.where("NOT valid").groupBy("slug", "language", "cause").agg(F.count("*").alias("n")).groupBy("slug", "language").agg(causes.alias("causes"))
    totals = report.groupBy("slug", "language").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("failed"))
    return totals.join(by_cause, ["slug", "language"], "left").withColumn("rate", F.round(F.col("failed") / F.col("files"), 6))
