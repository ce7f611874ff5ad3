"""Deeply nested semi-structured records as flat tables, by higher-order projection.

A payload is parsed once into a variant. Nested transform calls walk its arrays and attach the places of the ancestors,
flatten joins the arrays, and one inline per target table emits the rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

@dataclass(frozen=True)
class Field:
    """A column of a target table: ``name``, the path below the row's element, and the SQL type it is read as."""

    name: str
    path: str
    type: str = "string"


@dataclass(frozen=True)
class Target:
    """A flat table: the arrays from the root to its rows, the field that must be there, and its columns."""

    name: str
    arrays: tuple[str, ...]
    required: str = ""
    fields: tuple[Field, ...] = ()


def _listed(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")


def _boxed_keys(text: Column) -> Column:
    return F.map_keys(F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$", "map<string,variant>"))


@F.pandas_udf(StringType())
def _innermost(texts: pd.Series) -> pd.Series:
    def inner(text: str | None) -> str | None:
        try:
            while isinstance(text, str) and text.lstrip(" \t\r\n").startswith('"'):
                text = json.loads(text)
        except ValueError:
            return None
        return text if text is None else text.encode("utf-8", "replace").decode()  # half a surrogate pair is no UTF-8

    return texts.map(inner)


def unwrapped(text: Column) -> Column:
    """The text, or, where it is one JSON string and nothing else, what that string holds, however often it is wrapped."""
    # only what may be a string goes to Python; a string is longer than what it holds, so the loop ends
    wrapped = text.rlike(r'^[ \t\r\n]*"')
    return F.when(wrapped, _innermost(F.when(wrapped, text))).otherwise(text)


def opened(df: DataFrame, keys: Sequence[str], payload: str, root: str) -> DataFrame:
    """The distinct records with the payload as a variant ``root``, without those whose text isn't one JSON value.

    Spark's parser ignores what follows the first value. So the text is parsed inside brackets and inside braces, which
    together accept only one value and nothing after it.
    """
    texts = df.select(*[F.col(f"`{k}`") for k in keys], unwrapped(F.col(f"`{payload}`")).alias("_text")).distinct()
    listed, boxed = _listed(F.col("_text")), _boxed_keys(F.col("_text"))
    # a key given twice is valid JSON, the last one counts; the parser takes that setting when the plan is analysed, so the
    # session keeps its own afterwards
    conf, setting = df.sparkSession.conf, "spark.sql.variant.allowDuplicateKeys"
    before = conf.get(setting, "false")
    conf.set(setting, "true")
    try:
        # an element or a key that the text itself adds shows in the sizes
        return texts.withColumn("_listed", listed).where((F.size("_listed") == 1) & (F.size(boxed) == 1)).withColumn(root, F.col("_listed")[0]).drop("_text", "_listed")
    finally:
        conf.set(setting, before)


def elements(value: Column, path: str) -> Column:
    """The array at ``path``; an object in its place is an array of one, anything else an empty one."""
    at = F.try_variant_get(value, path, "variant")
    single = F.when(F.try_variant_get(value, path, "map<string,variant>").isNotNull(), F.array(at))
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), single, F.array().cast("array<variant>"))


def present(value: Column, path: str) -> Column:
    """Whether the field at ``path`` is there and not null, of whatever type."""
    at = F.try_variant_get(value, path, "variant")
    return at.isNotNull() & ~F.coalesce(F.is_variant_null(at), F.lit(True))


def rows_of(root: Column, target: Target) -> Column:
    """An array of struct(places of the ancestors..., element) of one target; places count from 0."""
    depth = len(target.arrays)

    def level(value: Column, at: int, places: list[Column]) -> Column:
        items = elements(value, target.arrays[at])
        if at + 1 == depth:
            return F.transform(items, lambda x, i: F.struct(*[p.alias(f"p{k}") for k, p in enumerate([*places, i])], x.alias("x")))
        return F.flatten(F.transform(items, lambda x, i: level(x, at + 1, [*places, i])))

    rows = level(root, 0, [])
    return F.filter(rows, lambda r: present(r["x"], target.required)) if target.required else rows


def flat_table(df: DataFrame, target: Target, payload: str, keys: Sequence[str]) -> DataFrame:
    """One flat table: the keys of the record, ``pos_<i>`` for each array on the way, and the target's fields.

    Repeated rows give one. Null, empty, damaged and foreign payloads give no row. Columns of ``df`` other than the keys are
    ignored.
    """
    depth = len(target.arrays)
    root = opened(df, keys, payload, "_root")
    fields = [F.try_variant_get(F.col("x"), f.path, f.type).alias(f.name) for f in target.fields]
    return root.select(*keys, F.inline(rows_of(F.col("_root"), target))).select(*keys, *[F.col(f"p{i}").cast("int").alias(f"pos_{i}") for i in range(depth)], *fields)


def entity_index(df: DataFrame, targets: Sequence[Target], payload: str, key: str) -> DataFrame:
    """All rows of all targets as (key, entity, parent_pos, pos), from one parse and one inline per record."""
    root = opened(df, [key], payload, "_root")

    def named(target: Target) -> Column:
        own = len(target.arrays) - 1

        def row(r: Column) -> Column:
            parent = r[f"p{own - 1}"] if own else F.lit(0)
            return F.struct(F.lit(target.name).alias("entity"), parent.cast("int").alias("parent_pos"), r[f"p{own}"].cast("int").alias("pos"))

        return F.transform(rows_of(F.col("_root"), target), row)

    lists = [named(t) for t in targets]
    return root.select(key, F.inline(F.concat(*lists))).distinct()


EDGE_FIELDS = (Field("kind", "$.kind"), Field("source_name", "$.source.qualified_name"), Field("target_name", "$.target.qualified_name"))
SPAN = ("slug", "commit_sha", "path", "blob_sha")


def _span(prefix: str) -> tuple[Field, ...]:
    return (*[Field(f, f"$.{prefix}.{f}") for f in SPAN], Field("start_line", f"$.{prefix}.start_line", "int"), Field("end_line", f"$.{prefix}.end_line", "int"))


#: The tables of code graphs, tasks and judgments.
EDGES = Target("edge", ("$.golden.edges",), "", EDGE_FIELDS)
SITES = Target("site", ("$.golden.edges",), "$.provenance.site.end_line", _span("provenance.site"))
BINDINGS = Target("binding", ("$.golden.edges",), "$.provenance.binding.commit_sha", _span("provenance.binding"))
TASKS = Target("task", ("$.tasks",), "", (Field("task_id", "$.task_id"),))
QRELS = Target("qrel", ("$.tasks", "$.gold.candidate_qrels"), "$.grade", (Field("grade", "$.grade"), *_span("identity")))
JUDGMENTS = Target("judgment", ("$.tasks", "$.judgments"), "$.source.path", (Field("grade", "$.grade"), *_span("source")))
