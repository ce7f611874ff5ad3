"""Dependency edges from lock files and manifests."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the files that are read.
NAMES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "package.json", "Cargo.lock", "Cargo.toml", "go.mod", "requirements.txt", "pyproject.toml")
_GO_VERSION = re.compile(r"v[0-9]+\.[0-9]+\.[0-9]+(?:[-+][0-9A-Za-z.+-]+)?\Z")
_PSEUDO = re.compile(r"-(?:0\.)?[0-9]{14}-([0-9a-f]{12})\Z")
_PIN = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*==\s*([0-9][A-Za-z0-9.!+-]*)\s*(?:#.*)?\Z")
_SPEC = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)")

Edge = tuple[str, str, str | None, str | None, str]  # ecosystem, name, version, resolved, spec


def _python_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.lower())


def _lock_tree(tree: object, out: list[Edge], notes: list[tuple[str, str]]) -> None:
    """Nested dependencies of the older lock format; a work list, so that depth doesn't matter."""
    work = [(tree, "")]
    while work:
        level, at = work.pop()
        if not isinstance(level, dict):
            continue
        for name, x in level.items():
            if not isinstance(x, dict) or not isinstance(x.get("version"), str):
                notes.append((f"dependencies{at}.{name}", "malformed"))
                continue
            out.append(("npm", name, x["version"], x.get("integrity") or x.get("resolved"), f"{name}@{x['version']}"))
            work.append((x.get("dependencies"), f"{at}.{name}"))


_PNPM = re.compile(r"  '?/?(@?[^@/'\s]+(?:/[^@/'\s]+)?)[@/]([0-9][^('\s:]*)[^:]*:\s*\Z")
_INTEGRITY = re.compile(r"\s+(?:resolution:\s*\{.*?)?integrity:?\s+\"?([A-Za-z0-9+/=-]+)")


def _pnpm(text: str) -> tuple[list[Edge], list[tuple[str, str]]]:
    """The packages of a pnpm lock file, whose section has one key a package: /name/version or name@version."""
    out: list[Edge] = []
    notes: list[tuple[str, str]] = []
    inside = False
    for i, line in enumerate(text.splitlines(), 1):
        if line and not line[0].isspace():
            inside = line.startswith("packages:")
        elif inside and re.match(r"  \S", line):
            if m := _PNPM.match(line):
                out.append(("npm", m[1], m[2], None, f"{m[1]}@{m[2]}"))
            else:
                notes.append((f"line:{i}", "unsupported"))
        elif inside and out and out[-1][3] is None and (m := _INTEGRITY.match(line)):
            out[-1] = (*out[-1][:3], m[1], out[-1][4])
    return out, notes


def _yarn(text: str) -> tuple[list[Edge], list[tuple[str, str]]]:
    """The packages of a yarn lock file: a head of one or more specs, then indented fields, of which version and integrity count."""
    out: list[Edge] = []
    notes: list[tuple[str, str]] = []
    names: list[str] = []
    at, version, resolved = 0, None, None

    def close() -> None:
        if names and version:
            out.append(("npm", names[0], version, resolved, f"{names[0]}@{version}"))
        elif names:
            notes.append((f"line:{at}", "malformed"))

    for i, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.startswith("#"):
            continue
        if not line[0].isspace():
            close()
            specs = [s.strip().strip('"') for s in line.rstrip(":").split(",")]
            names, at, version, resolved = [s[: s.rfind("@")] for s in specs if s.rfind("@") > 0 and not s.startswith("__")], i, None, None
        elif m := re.match(r"\s+version:?\s+\"?([^\"\s]+)\"?", line):
            version = m[1]
        elif m := re.match(r"\s+(?:integrity|checksum):?\s+\"?([^\"\s]+)\"?", line):
            resolved = m[1]
    close()
    return out, notes


def edges_of(name: str, text: str) -> tuple[str, list[Edge], list[tuple[str, str]]]:
    """(complete or direct-only, edges, notes on records that could not be read) of one file."""
    out: list[Edge] = []
    notes: list[tuple[str, str]] = []
    try:
        if name in ("package-lock.json", "package.json"):
            data = json.loads(text)
            if not isinstance(data, dict):
                return "direct-only", out, [("", "malformed")]
            if name == "package.json":
                for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
                    for k, v in (data.get(part) or {}).items() if isinstance(data.get(part), dict) else ():
                        out.append(("npm", k, None, None, v)) if isinstance(v, str) else notes.append((f"{part}.{k}", "malformed"))
                return "direct-only", out, notes
            if data.get("lockfileVersion") not in (2, 3):
                return "complete", out, [("lockfileVersion", "unsupported")]
            for path, x in (data.get("packages") or {}).items():
                if not path:
                    continue
                at = path.rfind("node_modules/")
                if at < 0 or not isinstance(x, dict) or not isinstance(x.get("version"), str):
                    notes.append((f"packages.{path}", "unsupported" if at < 0 else "malformed"))
                    continue
                package = path[at + 13 :]
                out.append(("npm", package, x["version"], x.get("integrity") or x.get("resolved"), f"{package}@{x['version']}"))
            _lock_tree(data.get("dependencies"), out, notes)
            return "complete", out, notes
        if name in ("Cargo.lock", "Cargo.toml", "pyproject.toml"):
            data = tomllib.loads(text)
            if name == "Cargo.lock":
                for i, x in enumerate(data.get("package") or []):
                    if not isinstance(x, dict) or not isinstance(x.get("name"), str) or not isinstance(x.get("version"), str):
                        notes.append((f"package[{i}]", "malformed"))
                    elif x.get("source") is not None:  # without a source it is a member of the project itself
                        out.append(("crates", x["name"], x["version"], x.get("checksum"), f"{x['name']}@{x['version']}"))
                return "complete", out, notes
            for k, v in (data.get("dependencies") or {}).items() if isinstance(data.get("dependencies"), dict) else ():
                out.append(("crates", k, None, None, v if isinstance(v, str) else str(v.get("version", "")) if isinstance(v, dict) else ""))
            for line in (data.get("project") or {}).get("dependencies") or []:
                m = _SPEC.match(line) if isinstance(line, str) else None
                out.append(("pypi", _python_name(m[1]), None, None, m[2].strip())) if m else notes.append((str(line)[:80], "malformed"))
            return "direct-only", out, notes
    except (ValueError, TypeError, AttributeError, RecursionError):
        return "direct-only", [], [("", "malformed")]
    if name == "pnpm-lock.yaml":
        return "complete", *_pnpm(text)
    if name == "yarn.lock":
        return "complete", *_yarn(text)
    if name == "go.mod":
        inside = False
        for i, raw in enumerate(text.splitlines(), 1):
            line = raw.split("//", 1)[0].strip()
            if line in ("require (", "require("):
                inside = True
            elif inside and line == ")":
                inside = False
            elif inside or line.startswith("require "):
                parts = line.removeprefix("require ").split() if not inside else line.split()
                if not parts:
                    continue
                if len(parts) != 2 or not _GO_VERSION.match(parts[1]):
                    notes.append((f"line:{i}", "malformed"))
                else:
                    m = _PSEUDO.search(parts[1])
                    out.append(("go", parts[0], parts[1], m[1] if m else None, f"{parts[0]}@{parts[1]}"))
        if inside:
            notes.append(("require-block", "malformed"))
        return "complete", out, notes
    for i, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := _PIN.match(line):
            out.append(("pypi", _python_name(m[1]), m[2], None, f"{_python_name(m[1])}=={m[2]}"))
        else:
            notes.append((f"line:{i}", "unsupported"))
    return "direct-only", out, notes


_FIELDS = ["slug", "commit_sha", "path", "graph_kind", "ecosystem", "name", "version", "resolved", "spec", "record", "note"]
EDGES = pa.schema([(f, pa.string()) for f in _FIELDS])
EDGES_DDL = ", ".join(f"{f} string" for f in _FIELDS)


def dependency_edges(files: DataFrame) -> DataFrame:
    """The dependency edges that manifests and lock files (slug, commit_sha, path, content) declare.

    A record that can't be read gives a row with only ``record`` and ``note`` (malformed or unsupported). Of repeated edges the
    greatest resolution stays. Null and unreadable contents give a note.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for slug, commit, path, content in zip(*(batch.column(c).to_pylist() for c in ("slug", "commit_sha", "path", "content"))):
                kind, edges, notes = edges_of(path.rsplit("/", 1)[-1], (content or b"").decode("utf-8", "replace"))
                rows += [(slug, commit, path, kind, *e, None, None) for e in edges]
                rows += [(slug, commit, path, kind, None, None, None, None, None, r, n) for r, n in notes]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=EDGES)

    wanted = files.where(F.element_at(F.split("path", "/"), -1).isin(*NAMES)).select("slug", "commit_sha", "path", "content")
    out = wanted.mapInArrow(run, EDGES_DDL)
    keys = [f for f in _FIELDS if f != "resolved"]
    return out.groupBy(*keys).agg(F.max("resolved").alias("resolved")).select(*_FIELDS)


def bills_of_materials(edges: DataFrame) -> DataFrame:
    """One JSON document for each pin: its packages with their addresses, and what they depend on, in order.

    A pin's packages stay in one row, as the document is one value.
    """
    from pinloom.functions.scalars import package_url

    known = edges.where("name IS NOT NULL").select("slug", "commit_sha", "ecosystem", "name", "version").distinct()
    package = F.struct(F.col("name").alias("name"), package_url(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"), F.col("version").alias("versionInfo"))
    grouped = known.groupBy("slug", "commit_sha").agg(F.array_sort(F.collect_list(package)).alias("packages"))
    document = F.struct(
        F.concat(F.lit("DOCUMENT-"), "slug").alias("name"), F.col("packages").alias("packages"),
        F.transform("packages", lambda p: F.struct(p["purl"].alias("relatedElement"), F.lit("DEPENDS_ON").alias("relationshipType"))).alias("relationships"), F.lit("SPDX-2.3").alias("spdxVersion"),
    )
    return grouped.select("slug", "commit_sha", F.size("packages").alias("packages"), F.to_json(document).alias("document"))
