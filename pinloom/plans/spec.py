"""Typed queries: predicates in three clauses over declared scopes."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

#: The kinds of predicates.
KINDS = ("exact_text", "token_sequence", "identifier", "symbol_definition", "symbol_reference", "signature", "call", "import", "path", "regex")
#: Other names of languages.
ALIASES = {"py": "python", "pypi": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}
SCOPED, GLOBAL = "scoped_exhaustive", "global_discovery"
_SLUG = re.compile(r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\Z")
_SHA = re.compile(r"[0-9a-f]{40}\Z")


class SpecError(ValueError):
    """A query that can't be run as it stands."""


def canonical_language(name: str) -> str:
    """The one name of a language, whatever case or alias it is given in."""
    lowered = name.casefold()
    return ALIASES.get(lowered, lowered)


@dataclass(frozen=True)
class Predicate:
    kind: str
    value: str
    language: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise SpecError(f"unknown kind of predicate: {self.kind}")
        if not isinstance(self.value, str) or not self.value.strip():
            raise SpecError("a predicate needs a value")
        if self.language is not None and not self.language.strip():
            raise SpecError("a language must have a name")
        if self.kind == "regex":
            try:
                re.compile(self.value)
            except re.error as e:
                raise SpecError(f"regex does not compile: {e}") from e

    @classmethod
    def parse(cls, text: str) -> Predicate:
        """From ``kind:value`` or ``kind:value:language``; the value may not hold a colon if a language follows."""
        kind, _, rest = text.partition(":")
        value, colon, language = rest.partition(":")
        return cls(kind, value, language) if colon else cls(kind, rest)


@dataclass(frozen=True)
class Scope:
    slug: str
    commit_sha: str

    def __post_init__(self) -> None:
        if not _SLUG.match(self.slug) or any(part in (".", "..") for part in self.slug.split("/")):
            raise SpecError(f"bad slug: {self.slug}")
        if not _SHA.match(self.commit_sha):
            raise SpecError(f"bad commit: {self.commit_sha}")


@dataclass(frozen=True)
class SearchSpec:
    """What to search: all musts, boosted by shoulds, without must_nots; scopes None means every pin of the table."""

    must: tuple[Predicate, ...]
    should: tuple[Predicate, ...] = ()
    must_not: tuple[Predicate, ...] = ()
    scopes: tuple[Scope, ...] | None = None
    whole_file_must: bool = False
    mode: str = SCOPED
    #: Whether a must_not drops the lines it hits rather than the whole file; no part of the query's identity.
    must_not_lines: bool = field(default=False, compare=False)
    languages: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        if not self.must:
            raise SpecError("a search needs at least one must predicate")
        if self.scopes is not None and self.mode == SCOPED and not self.scopes:
            raise SpecError("a scoped search needs a scope")
        found = {canonical_language(p.language) for p in self.must if p.language}
        if len(found) > 1:
            raise SpecError("conflicting required languages")
        object.__setattr__(self, "languages", tuple(found))

    @property
    def paths(self) -> tuple[Predicate, ...]:
        return tuple(p for p in self.must if p.kind == "path")

    @property
    def content_must(self) -> tuple[Predicate, ...]:
        return tuple(p for p in self.must if p.kind != "path")

    @property
    def content_must_not(self) -> tuple[Predicate, ...]:
        return tuple(p for p in self.must_not if p.kind != "path")

    @property
    def content_should(self) -> tuple[Predicate, ...]:
        return tuple(p for p in self.should if p.kind != "path")

    def digest(self) -> str:
        """The identity of the query: SHA-256 of its canonical JSON."""

        def clause(items: tuple[Predicate, ...]) -> list[dict[str, str]]:
            return [{"kind": p.kind, "language": p.language or "", "value": p.value} for p in items]

        whole = {
            "mode": self.mode, "must": clause(self.must), "must_not": clause(self.must_not), "should": clause(self.should),
            "scopes": [{"commit_sha": s.commit_sha, "slug": s.slug} for s in self.scopes or ()], "whole_file_must": self.whole_file_must,
        }
        return hashlib.sha256(json.dumps(whole, sort_keys=True).encode()).hexdigest()


#: Kinds that a remote index finds by a superset, which is filtered again here.
SUPERSET = frozenset(["path", "symbol_definition", "symbol_reference", "signature", "call", "import"])


def translation(spec: SearchSpec) -> tuple[str, list[tuple[str, int, str, str, str | None]]]:
    """The query text for a remote index, and what becomes of each predicate: (clause, index, kind, strategy, emitted).

    Predicates that the index can't express without losing matches are refused, not weakened.
    """
    terms, rows = [], []
    for i, p in enumerate(spec.must):
        if p.kind == "regex":
            raise SpecError("a remote index cannot express a regex must predicate")
        emitted = f"path:{p.value}" if p.kind == "path" else p.value
        terms.append(emitted)
        rows.append(("must", i, p.kind, "superset_local_filter" if p.kind in SUPERSET else "query", emitted))
    for clause, items in (("should", spec.should), ("must_not", spec.must_not)):
        for i, p in enumerate(items):
            if p.kind == "path":
                raise SpecError(f"a remote index cannot express a {clause} path predicate")
            rows.append((clause, i, p.kind, "local_filter", None))
    if spec.languages:
        terms.append(f"language:{next(p.language for p in reversed(spec.must) if p.language)}")
    return " ".join(terms), rows


def required_capabilities(spec: SearchSpec) -> list[tuple[str, str]]:
    """The (clause, kind) pairs that an index must be able to answer for a query, each once, in order."""
    return sorted({(clause, p.kind) for clause, items in (("must", spec.must), ("should", spec.should), ("must_not", spec.must_not)) for p in items})


def refused(spec: SearchSpec, port: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """What a query asks of an index that this one can't do; a query is run there only if that is nothing."""
    return [c for c in required_capabilities(spec) if c not in port]
