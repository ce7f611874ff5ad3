"""Scalar functions over names, versions, ratios and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pinloom.plans.spec import ALIASES


def ratio_bps(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator in basis points, half up; null for a denominator of 0."""
    exact = (F.lit(20000).cast("decimal(38,0)") * numerator + denominator.cast("decimal(38,0)")) / (F.lit(2) * denominator).cast("decimal(38,0)")
    return F.when(denominator > 0, F.floor(exact).cast("long"))


def band(score: Column) -> Column:
    """The display band of a score in basis points."""
    return F.when(score < 4000, "critical").when(score < 6000, "serious").when(score < 8000, "fair").when(score.isNotNull(), "good")


def overlap_lines(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The lines that two inclusive spans share."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def canonical_language(name: Column) -> Column:
    lowered = F.lower(name)
    return F.coalesce(*[F.when(lowered == k, v) for k, v in ALIASES.items()], lowered)


def normal_package(name: Column) -> Column:
    """A package name with runs of - _ . as one dash, lower-cased."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def escaped_module(path: Column) -> Column:
    """A module path in which each capital letter is an exclamation mark and the small letter."""
    return F.lower(F.regexp_replace(path, "([A-Z])", "!$1"))


def version_parts(text: Column) -> Column:
    """The numbers of a version, as an array that compares part by part; null if the text is none."""
    clean = F.regexp_extract(text, r"^v?([0-9]+(?:\.[0-9]+)*)$", 1)
    return F.when(clean != "", F.transform(F.split(clean, r"\."), lambda x: x.cast("long")))


def stable_version(text: Column) -> Column:
    """(major, minor, patch) of ``[v]X.Y.Z``, null for anything else."""
    fits = text.rlike(r"^v?[0-9]+\.[0-9]+\.[0-9]+$")
    part = lambda i: F.regexp_extract(text, r"^v?([0-9]+)\.([0-9]+)\.([0-9]+)$", i).cast("long")
    return F.when(fits, F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def package_url(ecosystem: Column, name: Column, version: Column) -> Column:
    kind = F.lower(ecosystem)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.replace(F.url_encode(name), F.lit("%2F"), F.lit("/")), F.when(version.isNotNull(), F.concat(F.lit("@"), F.url_encode(version))).otherwise(""))


def checksum_parts(text: Column) -> Column:
    """(algorithm, value) of ``algorithm:value``."""
    return F.when(text.contains(":"), F.struct(F.lower(F.element_at(F.split(text, ":"), 1)).alias("algorithm"), F.element_at(F.split(text, ":"), 2).alias("value")))


def module_name(path: Column) -> Column:
    """The dotted module of a source path, without a leading src and without the name of a package's own file."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"\.[A-Za-z]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/(__init__|index|mod)$", ""), "/", ".")


def age_score(released: Column, observed: Column) -> Column:
    """100, 75, 50 or 25 by whole days between two times; 50 if unknown or if the order is wrong."""
    days = F.floor((F.unix_micros(observed.cast("timestamp")) - F.unix_micros(released.cast("timestamp"))) / 86_400_000_000)
    known = released.isNotNull() & observed.isNotNull() & (released <= observed)
    return F.when(~F.coalesce(known, F.lit(False)), 50).when(days <= 365, 100).when(days <= 1095, 75).when(days <= 1825, 50).otherwise(25)


def redacted(text: Column) -> Column:
    """A log line without tokens, passwords and credentials in addresses."""
    text = F.regexp_replace(text, r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+", "$1 [redacted]")
    text = F.regexp_replace(text, r"(?i)\b(token|password|secret|api[_-]?key)(\s*[=:]\s*)[^\s&;,]+", "$1$2[redacted]")
    return F.regexp_replace(text, r"(https?://)[^/\s:@]+:[^/\s@]+@", "$1[redacted]@")


def path_words(path: Column) -> Column:
    """The lower-cased directories and name parts of a path, distinct and in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(path), F.lit("([a-z0-9]+)"), F.lit(1))))


def pinned_commit(ref_url: Column, html_url: Column) -> Column:
    """The commit that both addresses of a hit name, null unless they agree."""
    a, b = F.regexp_extract(ref_url, "[?&]ref=([0-9a-f]{40})", 1), F.regexp_extract(html_url, "/blob/([0-9a-f]{40})/", 1)
    return F.when((a == b) & (a != ""), a)


def failure_class(message: Column) -> Column:
    text = F.lower(message)
    return F.when(text.contains("timeout") | text.contains("timed out"), "timeout").when(text.contains("rate limit") | text.contains("429"), "rate_limit").when(text.contains("404") | text.contains("not found"), "not_found").when(text.contains("checksum") | text.contains("mismatch"), "integrity").otherwise("other")
