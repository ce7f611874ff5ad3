"""The catalog of pinned sources and their manifests: specs, lookup, upsert, validation, eligibility, listing."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

KEY = ["host", "owner", "repo", "commit_sha"]
#: Prefixes of package registries, and hosts by prefix.
REGISTRIES = {"npm": "npm", "pypi": "pypi", "pip": "pypi", "crates": "crates", "cargo": "crates", "go": "go"}
HOSTS = {"github": "github.com", "gitlab": "gitlab.com", "bitbucket": "bitbucket.org", "codeberg": "codeberg.org", "sourcehut": "git.sr.ht"}
_NPM = re.compile(r"(?:@[^/@\s]+/)?[^/@\s]+\Z")
_SHA = re.compile(r"[0-9a-f]{40}\Z")
_OWNER = re.compile(r"[A-Za-z0-9~_.][A-Za-z0-9~_.-]*\Z")


class SourceSpecError(ValueError):
    """A source that can't be named this way."""


@dataclass(frozen=True)
class SourceSpec:
    """A package (ecosystem, name, version) or a repository (host, name, ref, ref_kind: branch, tag or sha)."""

    raw: str
    ecosystem: str | None = None
    name: str = ""
    version: str | None = None
    host: str | None = None
    ref: str | None = None
    ref_kind: str | None = None


def _repository(raw: str, host: str, path: str, ref: str | None = None, kind: str | None = None) -> SourceSpec:
    parts = path.split("/")
    if len(parts) < 2 or (host != "gitlab.com" and len(parts) > 2) or not all(_OWNER.match(p) and p not in (".", "..") for p in parts):
        raise SourceSpecError(f"not a repository: {raw}")
    parts[-1] = parts[-1].removesuffix(".git")
    return SourceSpec(raw, None, "/".join(parts), None, host, ref, "sha" if ref and _SHA.match(ref) else kind)


def _short(raw: str, host: str, text: str) -> SourceSpec:
    text = text.rstrip("/")
    marks = [c for c in "#@" if c in text]
    if len(marks) > 1 or (marks and (text.count(marks[0]) > 1 or text.endswith(marks[0]))):
        raise SourceSpecError(f"conflicting or empty ref: {raw}")
    path, _, ref = text.partition(marks[0]) if marks else (text, "", "")
    return _repository(raw, host, path, ref or None, {"#": "branch", "@": "tag"}.get(marks[0]) if marks else None)


def _address(raw: str) -> SourceSpec:
    try:
        url = urlsplit(raw)
        port = url.port
    except ValueError as e:
        raise SourceSpecError(f"malformed address: {raw}") from e
    host = (url.hostname or "").lower()
    if url.scheme.lower() != "https" or host not in HOSTS.values() or url.username or url.password or port not in (None, 443) or url.query or url.fragment:
        raise SourceSpecError(f"unsupported address: {raw}")
    parts = [unquote(p) for p in url.path.strip("/").split("/")]
    if len(parts) < 2 or not all(parts):
        raise SourceSpecError(f"no repository in: {raw}")
    # what follows the project: /tree/ref, of one host /-/tree/ref after groups of any depth, of others /src/ref or /refs/...
    for i in range(2, len(parts)):
        rest = parts[i + 1 :] if host == "gitlab.com" and parts[i] == "-" else parts[i:]
        if host == "git.sr.ht" and parts[i] == "refs":
            return _repository(raw, host, "/".join(parts[:i]), "/".join(parts[i:]), "branch")
        if rest and rest[0] in ({"src"} if host == "bitbucket.org" else {"tree", "blob"}):
            if len(rest) < 2:
                break
            return _repository(raw, host, "/".join(parts[:i]), rest[1], "branch")
    return _repository(raw, host, "/".join(parts))


def _package(raw: str, ecosystem: str, text: str) -> SourceSpec:
    at = text.rfind("@")
    name, version = (text[:at], text[at + 1 :]) if at > 0 else (text, None)
    if not name or version == "" or any(c.isspace() for c in text) or "@" in name[1:] or (ecosystem == "npm" and not _NPM.match(name)) or (ecosystem == "go" and "/" not in name):
        raise SourceSpecError(f"not a package: {raw}")
    return SourceSpec(raw, ecosystem, name, version)


def parse_source(raw: str) -> SourceSpec:
    """A source as users write it: ``registry:name@version``, ``host:owner/repo@tag``, ``owner/repo#branch``, an https address, or the
    bare name of a package. Malformed ones raise SourceSpecError."""
    if not raw or raw != raw.strip():
        raise SourceSpecError("a source must be a text without blanks around it")
    if "://" in raw:
        return _address(raw)
    prefix, colon, rest = raw.partition(":")
    if colon:
        if (registry := REGISTRIES.get(prefix.lower())) and rest:
            return _package(raw, registry, rest)
        if host := HOSTS.get(prefix.lower()):
            return _short(raw, host, rest)
        raise SourceSpecError(f"unknown prefix: {raw}")
    for host in HOSTS.values():
        if raw.lower().startswith(host + "/"):
            return _short(raw, host, raw[len(host) + 1 :])
    if not raw.startswith("@") and "/" in raw:
        return _short(raw, "github.com", raw)
    return _package(raw, "npm", raw)


_PARTS = ("ecosystem", "name", "version", "host", "ref", "ref_kind", "error")


@F.pandas_udf(StructType([StructField(n, StringType()) for n in _PARTS]))
def parsed_source(raw: pd.Series) -> pd.DataFrame:
    """``parse_source`` over a column, by distinct text; what can't be parsed has only an error."""

    def one(text):
        try:
            s = parse_source(text)
            return (s.ecosystem, s.name, s.version, s.host, s.ref, s.ref_kind, None)
        except SourceSpecError as e:
            return (None,) * 6 + (str(e).partition(":")[0],)

    table = {x: one(x) for x in raw.dropna().unique()}
    return pd.DataFrame([table.get(x, (None,) * 7) for x in raw], columns=list(_PARTS))


def scan_catalog(catalog: DataFrame, manifests: DataFrame) -> DataFrame:
    """The catalog's entries with their manifests: state ``found`` or ``missing_manifest``. Keys must be unique in the manifests."""
    held = manifests.withColumn("_m", F.lit(True))
    return catalog.join(held, KEY, "left").withColumn("state", F.when(F.col("_m"), "found").otherwise("missing_manifest")).drop("_m")


def lookup(sources: DataFrame, spec: SourceSpec) -> DataFrame:
    """The sources (entries with manifests) that a spec names: a bare package name matches in any registry; a version may be a version,
    a tag or a commit; a ref a tag, a branch or a commit."""
    bare = spec.ecosystem == "npm" and spec.version is None and spec.host is None and spec.name == spec.raw
    if bare:
        return sources.where(F.col("name") == spec.name)
    if spec.ecosystem is not None:
        out = sources.where((F.col("ecosystem") == spec.ecosystem) & (F.col("name") == spec.name))
        return out if spec.version is None else out.where(F.lit(spec.version).isin(F.col("version"), F.col("tag"), F.col("commit_sha")))
    out = sources.where((F.col("host") == spec.host) & (F.concat_ws("/", "owner", "repo") == spec.name))
    if spec.ref is None:
        return out
    if spec.ref_kind == "sha":
        return out.where(F.col("commit_sha") == spec.ref)
    return out.where(F.coalesce(F.col("tag") == spec.ref, F.lit(False)) | F.coalesce(F.col("branch") == spec.ref, F.lit(False)) | (F.col("commit_sha") == spec.ref))


def upsert(catalog: DataFrame, updates: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The catalog with the rows of ``updates`` in place of those of the same key. Of several updates of a key the greatest counts."""
    key = key or KEY
    rest = [c for c in catalog.columns if c not in key]
    new = updates.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
    return catalog.join(new.select(*key), key, "left_anti").unionByName(new.select(*catalog.columns))


def remove(catalog: DataFrame, gone: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The catalog without the keys of ``gone``."""
    return catalog.join(gone.select(*(key or KEY)).distinct(), key or KEY, "left_anti")


def _failing(checks: dict[str, Column]) -> Column:
    """The names of the checks that don't hold, in order; a check that can't be told doesn't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(checks.items())]))


def manifest_problems() -> Column:
    """What is wrong with a manifest row (commit_sha, owner, repo, fetched_at, parity, verified, checksum, tree_hash); empty if it is valid."""
    segment = r"^[A-Za-z0-9_.-]+$"
    optional = lambda c, ok: F.col(c).isNull() | ok
    return _failing({
        "commit_sha": F.col("commit_sha").rlike("^[0-9a-f]{40}$"), "owner": F.col("owner").rlike(segment) & ~F.col("owner").isin(".", ".."), "repo": F.col("repo").rlike(segment) & ~F.col("repo").isin(".", ".."),
        "fetched_at": F.col("fetched_at").isNotNull(), "parity": F.col("parity").isin("exact", "drift", "unknown"), "verified": F.col("verified").isin("true", "sampled", "archive-only", "false"),
        "checksum": optional("checksum", F.col("checksum").rlike("^(sha(1|256|512):)?[0-9a-f]{40,128}$")), "tree_hash": F.col("tree_hash").rlike("^h1:[A-Za-z0-9+/]{43}=$"),
    })


def index_problems() -> Column:
    """The conditions that keep a manifest from being indexed: source, parity, scope."""
    return _failing({"source": F.col("source") == "git-commit", "parity": F.col("parity") == "exact", "scope": F.col("scope") == "full"})


def pin(catalog_sha: Column, manifest_sha: Column, fallback: Column) -> Column:
    """The commit of a shelf: the catalog's, else the manifest's, else the fallback; malformed ones don't count."""
    good = lambda c: F.when(c.rlike("^[0-9a-f]{40}$"), c)
    return F.coalesce(good(catalog_sha), good(manifest_sha), fallback)


def listing(catalog: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row for each entry with a valid manifest and a trust from 0 to 100, and the counts of those left out in one row of state
    ``excluded``: (host, owner, repo, commit_sha, trust, route, state, n)."""
    joined = catalog.join(manifests.withColumn("_bad", F.size(manifest_problems())), KEY, "left")
    good = F.coalesce((F.col("_bad") == 0) & F.col("trust").between(0, 100), F.lit(False))
    listed = joined.where(good).select(*KEY, F.col("trust").cast("int").alias("trust"), "route", F.lit("listed").alias("state"), F.lit(1).cast("long").alias("n"))
    none = F.lit(None)
    left = joined.where(~good).agg(F.count("*").alias("n")).select(*[none.cast("string").alias(c) for c in KEY], none.cast("int").alias("trust"), none.cast("string").alias("route"), F.lit("excluded").alias("state"), "n")
    return listed.unionByName(left)
