"""Predicates as boolean columns over one line, for each language."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pinloom.plans.spec import Predicate

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p

#: Endings of the languages, in the order in which they are tried. The first three match case as spelt.
SUFFIXES = [
    ("python", (".py",)), ("rust", (".rs",)), ("go", (".go",)), ("javascript", (".js", ".mjs", ".cjs")), ("typescript", (".ts", ".tsx")),
    ("java", (".java",)), ("c", (".c", ".h")), ("cpp", (".cc", ".cpp", ".cxx", ".hpp", ".hh")),
]
EXACT_CASE = ("python", "rust", "go")
MASKED = ["javascript", "typescript", "java", "c", "cpp"]
#: Java flags that make a pattern mean what it means in Python: Unicode classes, and only \\n ends a line.
FLAGS = "(?Ud)"


def language_of(path: Column) -> Column:
    """The language whose adapter takes a path, null if none does."""
    out = F.lit(None).cast("string")
    for language, endings in reversed(SUFFIXES):
        tried = path if language in EXACT_CASE else F.lower(path)
        hit = F.lit(False)
        for e in endings:
            hit = hit | tried.endswith(e)
        out = F.when(hit, language).otherwise(out)
    return out


def quoted(value: str) -> str:
    """The value as a literal in a Java pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}#&~\-<>=!/ ])", r"\\\1", value).replace("\n", "\\n")


_SAFE = {_c.LITERAL, _c.NOT_LITERAL, _c.ANY, _c.IN, _c.BRANCH, _c.MAX_REPEAT, _c.MIN_REPEAT, _c.SUBPATTERN, _c.AT, _c.ASSERT, _c.ASSERT_NOT}


def java_pattern(pattern: str) -> str | None:
    """A Python pattern as a Java one of the same meaning over single lines; null if that can't be told."""
    if re.search(r"\(\?[aiLmsux-]|\(\?\(|\(\?P[=>]|\\[NZ]|\\[0-9]|\[[^\]]*(?:&&|\[)|\{,", pattern):
        return None
    try:
        parsed = _p.parse(pattern)
    except re.error:
        return None

    def safe(items) -> bool:
        for op, arg in items:
            if op not in _SAFE:
                return False
            if op is _c.BRANCH and not all(safe(x) for x in arg[1]):
                return False
            if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and not safe(arg[2]):
                return False
            if op is _c.SUBPATTERN and (arg[1] or arg[2] or not safe(arg[3])):
                return False
            if op in (_c.ASSERT, _c.ASSERT_NOT) and not safe(arg[1]):
                return False
        return True

    return FLAGS + re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'U')}>", pattern) if safe(parsed) else None


#: What a definition of the name N looks like, matched at the head of a line.
DEFINITIONS = {
    "python": (r"^\s*(?:async\s+)?(?:def|class)\s+N\b", r"^\s*N\s*[:=]"),
    "rust": (
        r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn|struct|enum|trait|type|mod)\s+N\b",
        r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+N\b",
        r"^\s*impl\s+(?:<[^>]*>\s+)?N\b",
    ),
    "go": (r"^\s*func\s+(?:\([^)]*\)\s+)?N\b", r"^\s*type\s+N\s+(?:struct|interface)\b", r"^\s*(?:const|var)\s+N\b"),
}
_MODIFIERS = r"(?:(?:public|protected|private|static|abstract|override|readonly|async|get|set)\s+)*"
#: The same for languages whose comments and strings are masked; N is the name, followed by what ends it.
DEFINITIONS["javascript"] = (
    r"^\s*export\s+(?:default\s+)?(?:async\s+)?function\s+N\s*\([^\r\n{};]*\)",
    r"^\s*export\s+(?:default\s+)?class\s+N(?![\w$])",
    r"^\s*export\s+(?:declare\s+)?(?:const|let|var)\s+N\s*(?::\s*[^=;]+)?\s*=",
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+N\b(?!\$+\w)",
    r"^\s*(?:export\s+)?class\s+N\b(?!\$+\w)",
    r"^\s*(?:export\s+)?(?:const|let|var)\s+N\s*(?::[^=]+)?=",
    rf"^\s*{_MODIFIERS}N\s*\([^\r\n{{}};]*\)(?:\s*:\s*[^={{;]+)?\s*\{{",
)
DEFINITIONS["typescript"] = DEFINITIONS["javascript"]
DEFINITIONS["java"] = (
    r"^\s*(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed)\s+)*(?:class|interface|enum|record)\s+N\b(?!\$+\w)",
    r"^\s*(?:(?:public|protected|private|abstract|final|static|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?[A-Za-z_$][\w$<>,.?\[\]]*\s+N\s*\([^;]*\)\s*(?:throws\b[^\{]+)?\{",
)
DEFINITIONS["c"] = (r"^\s*(?:[A-Za-z_]\w*[\s*]+)+N\s*\([^;]*\)\s*\{", r"^\s*(?:typedef\s+)?(?:struct|union|enum)\s+N\b", r"^\s*typedef\b.*\bN\s*;\s*$")
DEFINITIONS["cpp"] = DEFINITIONS["c"]
#: Words that a signature line holds; of masked languages a definition of any name.
SIGNATURE_WORDS = {"python": ("def ", "class "), "rust": ("fn ", "struct ", "trait "), "go": ("func", "type")}
#: How import lines begin or what they hold.
IMPORTS = {"python": r"^\s*(?:import |from )", "rust": r"^\s*use ", "javascript": r"^\s*import\b|\brequire\s*\(", "typescript": r"^\s*import\b|\brequire\s*\(", "java": r"^\s*import\s+", "c": r"^\s*#\s*include\b", "cpp": r"^\s*#\s*include\b"}
#: Names as masked languages have them.
NAME = r"[A-Za-z_$][\w$]*"


def register_language(language: str, endings: tuple[str, ...], definitions: tuple[str, ...], imports: str) -> None:
    """Adds a language to the search: its text is masked, N in a definition stands for the name. Languages known here are closed, and a
    language can be added once; patterns must mean the same to Spark as to Python."""
    if any(language == name for name, _ in SUFFIXES) or any(e in known for e in endings for _, known in SUFFIXES):
        raise ValueError(f"{language} or one of its endings is known")
    if not endings or not all(e.startswith(".") for e in endings) or not definitions or not all(java_pattern(p.replace("N", "x")) for p in (*definitions, imports)):
        raise ValueError("a language needs endings, and patterns that Spark can run")
    SUFFIXES.append((language, tuple(endings)))
    MASKED.append(language)
    DEFINITIONS[language], IMPORTS[language] = tuple(definitions), imports


def any_of(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def holds_word(line: Column, value: str) -> Column:
    return line.rlike(rf"{FLAGS}\b{quoted(value)}\b")


def definition_pattern(language: str, name: str) -> str:
    """The definitions of a name, as one Java pattern."""
    return "|".join(re.sub(r"(?<![A-Za-z])N(?![A-Za-z])", lambda _: name, d) for d in DEFINITIONS[language])


def line_predicate(p: Predicate, language: str) -> Callable[[Column], Column] | None:
    """The test of one line under a language's rules; null for a regex that only Python can run."""
    v = p.value
    if p.kind == "exact_text":
        return lambda line: line.contains(v)
    if p.kind in ("regex", "signature"):
        pattern = java_pattern(v)
        if pattern is None:
            return None
        if p.kind == "regex":
            return lambda line: line.rlike(pattern)
        if language in MASKED:
            anything = FLAGS + definition_pattern(language, NAME)
            return lambda line: line.rlike(pattern) & line.rlike(anything)
        return lambda line: line.rlike(pattern) & any_of([line.contains(w) for w in SIGNATURE_WORDS[language]])
    if p.kind == "identifier":
        return lambda line: holds_word(line, v)
    if p.kind == "token_sequence":
        tokens = r"\s+".join(quoted(t) for t in v.split())
        return lambda line: line.rlike(rf"{FLAGS}\b{tokens}\b")
    if p.kind == "import":
        if language == "go":
            return lambda line: (line.contains("import") | line.contains('\t"')) & line.contains(v)
        return lambda line: line.rlike(FLAGS + IMPORTS[language]) & line.contains(v)
    if language in MASKED:
        if not re.fullmatch(NAME, v):
            return lambda line: F.lit(False)
        alone = rf"{FLAGS}(?<![\w$]){quoted(v)}(?![\w$])"
        if p.kind == "call":
            return lambda line: line.rlike(rf"{alone}\s*\(")
        definition = FLAGS + definition_pattern(language, quoted(v))
        if p.kind == "symbol_definition":
            return lambda line: line.rlike(definition)
        return lambda line: line.rlike(alone) & ~line.rlike(definition)
    if p.kind == "call":
        opening = "[(<]" if language == "rust" else r"\("
        return lambda line: line.rlike(rf"{FLAGS}\b{quoted(v)}\s*{opening}")
    definition = definition_pattern(language, quoted(v))
    if p.kind == "symbol_definition":
        return lambda line: line.rlike(FLAGS + definition)
    if p.kind == "symbol_reference":
        return lambda line: holds_word(line, v) & ~line.rlike(FLAGS + definition)
    raise ValueError(p.kind)


def needed_text(p: Predicate) -> str | None:
    """A text that every line the predicate hits must hold; null if there is none."""
    if p.kind in ("exact_text", "identifier", "symbol_definition", "symbol_reference", "call", "import"):
        return p.value
    return p.value.split()[0] if p.kind == "token_sequence" else None


def path_predicate(p: Predicate, path: Column) -> Column:
    """A path predicate: the value as a part of the path, or as a regex over it if it is one."""
    pattern = java_pattern(p.value)
    return path.contains(p.value) | path.rlike(pattern) if pattern else path.contains(p.value)


_MASK = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)" + "".join(rf"|{q}(?:[^{q}\\]|\\[\s\S])*(?:{q}|\\?\Z)" for q in "\"'`"))
_VISIBLE = re.compile(r"[^\n]")


def masked(text: str) -> str:
    """A text with comments and strings blanked out; line ends stay, so that lines keep their numbers. A string ends only at its quote."""
    return _MASK.sub(lambda m: _VISIBLE.sub(" ", m.group()), text)
