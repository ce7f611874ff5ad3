"""Licence evidence, addresses and places in texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How SPDX markers look, and licence ids by a part of a file's name.
MARKER = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]+)"
FILE_NAMES = {"mit": "MIT", "apache": "Apache-2.0", "bsd": "BSD-3-Clause", "mpl": "MPL-2.0", "unlicense": "Unlicense", "isc": "ISC", "zlib": "Zlib", "cc0": "CC0-1.0"}


def spdx_markers(text: Column) -> Column:
    """The expressions of the SPDX markers in a text, trimmed, distinct, in text order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")))


def licence_of_name(path: Column) -> Column:
    """The licence that a file's name tells, as ``LICENSE-MIT`` or ``mit.txt``; null if it tells none."""
    words = F.split(F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(txt|md|rst)$", "")), r"[^a-z0-9]+")
    out = F.lit(None).cast("string")
    for word, spdx in reversed(FILE_NAMES.items()):
        out = F.when(F.array_contains(words, word), spdx).otherwise(out)
    return out


def routing_evidence(text: Column) -> Column:
    """Marks in a text that bear on where it may go: copyleft, noncommercial, proprietary, permissive; distinct and in order."""
    tests = {
        "copyleft": r"(?i)\b(?:gpl|agpl|lgpl|general public licen[cs]e)\b", "noncommercial": r"(?i)\bnon-?commercial\b", "permissive": r"(?i)\b(?:mit|apache|bsd|isc)\b", "proprietary": r"(?i)\b(?:proprietary|confidential|all rights reserved)\b",
    }
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in sorted(tests.items())]))


def byte_column(line: Column, characters: Column) -> Column:
    """The byte column of a place in a line that is given in characters, both from 0."""
    return F.octet_length(F.substring(line, F.lit(1), characters))


def character_column(line: Column, octets: Column) -> Column:
    """The character column of a place given in bytes; null if it lies within a character."""
    head = F.substring(F.encode(line, "UTF-8"), F.lit(1), octets)
    return F.when(F.is_valid_utf8(head.cast("string")), F.char_length(head.cast("string")))


def docs_urls(document: Column) -> Column:
    """Addresses of documentation in a registry's JSON: fields documentation, docs_url, homepage, and project_urls of such names."""
    own = F.array(*[F.get_json_object(document, f"$.{f}") for f in ("documentation", "docs_url", "homepage")])
    more = F.array(*[F.get_json_object(document, f"$.info.project_urls.{f}") for f in ("Documentation", "Docs", "Homepage")])
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(F.concat(own, more)), lambda x: x.rlike("^https?://"))))


def http_class(status: Column, remaining: Column) -> Column:
    """What an HTTP status means for a retry: ok, rate_limited, retry, gone, denied or failed."""
    limited = (status == 429) | ((status == 403) & F.coalesce(remaining == 0, F.lit(False)))
    return F.when(status.between(200, 299), "ok").when(limited, "rate_limited").when(status.isin(408, 425, 500, 502, 503, 504), "retry").when(status.isin(404, 410), "gone").when(status.isin(401, 403), "denied").otherwise("failed")


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait from a Retry-After header: a number, or a date after ``now``; null if it is neither."""
    seconds = F.when(header.rlike("^[0-9]+$"), header.cast("long"))
    when = F.try_to_timestamp(F.regexp_extract(header, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(seconds, F.when(when.isNotNull(), F.greatest(F.lit(0), F.unix_seconds(when) - F.unix_seconds(now))))
