"""Symbols and static edges of JavaScript, TypeScript, Go and Rust sources, by a scan of masked text; and the registry of producers.

Python's come from its syntax tree (``operators/symbols.py``). Here comments and strings are blanked first, so that brackets and
words count; definitions open scopes that their brackets close; every call, base, construction and throw is resolved to the
one definition of that name in the file, or to the import that brought the name, and is unresolved otherwise.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinloom.operators.symbols import python_facts

_BLANK = re.compile(r"[^\n]")
_STRINGS = {
    "javascript": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*`?"),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|`[^`]*`?|'(?:[^'\\\n]|\\.[^'\n]*)'"),
    "rust": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\bb?r(#*)\"[\s\S]*?\"\1|b?\"(?:[^\"\\]|\\[\s\S])*\"?|b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'"),
}
_STRINGS["typescript"] = _STRINGS["javascript"]


def masked_source(language: str, text: str) -> str:
    """The text with comments and strings blanked out, as long as before; quotes stay, so that places keep their meaning."""
    return _STRINGS[language].sub(lambda m: _BLANK.sub(" ", m.group()), text)


@dataclass
class Found:
    """What a file holds: symbols (kind, qualified name, line, signature), edges (kind, source, target, line), unresolved references."""

    symbols: list[tuple[str, str, int, str]] = field(default_factory=list)
    edges: list[tuple[str, str, str, int]] = field(default_factory=list)
    unresolved: list[tuple[str, str, str, int]] = field(default_factory=list)


_NAME = r"[A-Za-z_$][\w$]*"
#: Words that look like calls but are none.
_NO_CALLS = {
    "javascript": frozenset("if for while switch catch function return typeof await yield new super import constructor in of do else case delete void require".split()),
    "go": frozenset("if for switch select func import return go defer range map chan interface struct append cap close complex copy delete imag len make new panic print println real recover".split()),
    "rust": frozenset("if while for match loop fn return let in as move unsafe impl where Some Ok Err None Box Vec".split()),
}
_NO_CALLS["typescript"] = _NO_CALLS["javascript"]
_DEFINED = {
    "javascript": re.compile(
        rf"\bclass\s+(?P<class>{_NAME})(?:\s+extends\s+(?P<base>[\w$.]+))?|\bfunction\s*\*?\s*(?P<function>{_NAME})\s*\(|\b(?:const|let|var)\s+(?P<arrow>{_NAME})\s*=\s*(?:async\s*)?(?:\([^()]*\)|{_NAME})\s*=>"
        rf"|^[ \t]*(?:(?:static|async|get|set|public|private|protected)\s+)*\*?(?P<method>#?{_NAME})\s*\([^(){{}};]*\)\s*(?::\s*[^={{;]+)?\{{|\bnew\s+(?P<new>[\w$.]+)|(?<![\w$])(?P<call>{_NAME}(?:\.{_NAME})*)\s*\(",
        re.M,
    ),
    "go": re.compile(
        r"\bfunc\s*\(\s*\w*\s*\*?(?P<receiver>\w+)[^)]*\)\s*(?P<method>\w+)\s*[(\[]|\bfunc\s+(?P<function>\w+)\s*[(\[]|\btype\s+(?P<class>\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\b|&?\b(?P<new>[A-Z]\w*)\{|(?<![\w.])(?P<call>\w+(?:\.\w+)*)\s*\("
    ),
    "rust": re.compile(
        r"\b(?:struct|enum|union)\s+(?P<class>\w+)|\btrait\s+(?P<trait>\w+)|\bimpl\b(?:\s*<[^{};]*?>)?\s+(?:(?P<base>[\w:]+)(?:<[^{};]*?>)?\s+for\s+)?(?P<owner>\w+)|\bfn\s+(?P<function>\w+)|(?<![\w!:.])(?P<call>\w+(?:::\w+)*)\s*\("
    ),
}
_DEFINED["typescript"] = _DEFINED["javascript"]
_THROW = re.compile(rf"\bthrow\s+new\s+({_NAME})")


def _imports(language: str, text: str, clean: str) -> dict[str, str]:
    """Local name -> where it comes from."""
    out: dict[str, str] = {}
    if language in ("javascript", "typescript"):
        for m in re.finditer(r"^[ \t]*import\s+(?:type\s+)?([\w$*{},\s]+?)\s+from\s*([\"'])(.+?)\2", text, re.M):
            if clean[m.start() : m.start() + 40].strip().startswith("import"):
                for part in re.findall(rf"(\*|{_NAME})(?:\s+as\s+({_NAME}))?", m[1]):
                    if part[0] not in ("as", "type"):
                        out[part[1] or part[0]] = f"{m[3]}:{part[0]}"
        for m in re.finditer(rf"\b(?:const|let|var)\s+(?:({_NAME})|\{{([^}}]*)\}})\s*=\s*require\(\s*([\"'])(.+?)\3", text):
            for name in [m[1]] if m[1] else re.findall(_NAME, m[2]):
                out[name] = f"{m[4]}:{name if m[2] else '*'}"
    elif language == "go":
        for m in re.finditer(r"^import\s*(\([\s\S]*?\)|[^\n]*)", clean, re.M):
            for name, path in re.findall(r"^[ \t]*(?:import\s+)?(\w+|\.|_)?[ \t]*[\"`]([^\"`\n]+)[\"`]", text[m.start() : m.end()], re.M):
                out[name if name and name not in ("import", ".", "_") else path.rpartition("/")[2]] = path
    else:
        for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", clean, re.M):
            _use(re.sub(r"\s+", " ", m[1]).strip(), "", out)
    return out


def _use(tree: str, prefix: str, out: dict[str, str]) -> None:
    """One tree of a use declaration, its braces opened."""
    head, brace, rest = tree.partition("{")
    if brace:
        depth, part = 0, ""
        for c in rest[: rest.rfind("}")] + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                if part.strip():
                    _use(part.strip(), prefix + head, out)
                part = ""
            else:
                part += c
        return
    path, _, local = tree.partition(" as ")
    full = prefix + path.strip()
    name = local.strip() or full.rpartition("::")[2]
    if name not in ("*", "_"):
        out[full.split("::")[-2] if name == "self" and "::" in full else name] = full.removesuffix("::self")


def _closing(clean: str, start: int) -> int:
    """The place behind the brackets that open at or after ``start``; the end of the line if none opens before a semicolon."""
    depth = 0
    for i in range(start, len(clean)):
        c = clean[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c in ";" and not depth:
            return i
    return len(clean)


def scan(language: str, module: str, text: str) -> Found:
    """The symbols, edges and unresolved references of one file."""
    clean = masked_source(language, text)
    imports = _imports(language, text, clean)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda i: bisect.bisect_right(starts, i)
    out, scopes, pending = Found(), [], []  # scopes: (begin, end, qualified name, class or not)

    def owner(i: int, classes: bool = False) -> str:
        inside = [s for s in scopes if s[0] < i < s[1] and (s[3] or not classes)]
        return max(inside)[2] if inside else ""

    for m in _DEFINED[language].finditer(clean):
        kind, i = m.lastgroup, m.start()
        g = m.groupdict()
        if name := g.get("class") or g.get("trait"):
            end = _closing(clean, m.end())
            out.symbols.append(("class" if g.get("class") else "trait", name, line(m.start(kind if kind != "base" else "class")), " ".join(text[i : m.end()].split())))
            scopes.append((i, end, name, True))
            if g.get("base"):
                pending.append(("inherits", name, g["base"], i))
            if language == "go":
                body = clean[m.end() : end]
                for e in re.finditer(r"^[ \t]*\*?(\w+(?:\.\w+)?)[ \t]*$", body, re.M):
                    pending.append(("inherits", name, e[1], m.end() + e.start(1)))
        elif g.get("owner"):
            scopes.append((i, _closing(clean, m.end()), g["owner"], True))
            if g.get("base"):
                pending.append(("inherits", g["owner"], g["base"].rpartition("::")[2], i))
        elif name := g.get("function") or g.get("arrow") or g.get("method"):
            if language in ("javascript", "typescript") and g.get("method") and (name in _NO_CALLS["javascript"] and name != "constructor" or not owner(i + 1, True)):
                continue
            above = g.get("receiver") or (owner(i, True) if g.get("method") or language == "rust" else owner(i))
            qualified = f"{above}.{name}" if above else name
            at = m.start("function" if g.get("function") else "arrow" if g.get("arrow") else "method")
            end = _closing(clean, m.end() - (clean[m.end() - 1] == "{"))
            out.symbols.append(("method" if g.get("method") or (language == "rust" and above) else "function", qualified, line(at), " ".join(text[i : min(end, clean.find("\n", m.end()) if clean.find("\n", m.end()) > 0 else end)].rstrip(" {\n").split())))
            scopes.append((i, end, qualified, False))
        elif g.get("new"):
            pending.append(("instantiates", owner(i), g["new"], i))
        elif g.get("call"):
            name = g["call"]
            if name.replace("::", ".").split(".")[-1] not in _NO_CALLS[language] and name not in _NO_CALLS[language]:
                pending.append(("calls", owner(i), name.replace("::", "."), i))
    for m in _THROW.finditer(clean) if language in ("javascript", "typescript") else ():
        pending.append(("raises", owner(m.start()), m[1], m.start()))
    known: dict[str, set[str]] = {}
    for kind, qualified, _, _ in out.symbols:
        if kind != "method":
            known.setdefault(qualified.rpartition(".")[2], set()).add(qualified)
    for local, origin in imports.items():
        out.edges.append(("imports", module, origin, next((line(m.start()) for m in re.finditer(rf"\b{re.escape(local)}\b", text)), 1)))
    for kind, source, name, i in pending:
        head, _, tail = name.partition(".")
        source = f"{module}.{source}" if source else module
        if not tail and len(known.get(head, ())) == 1:
            out.edges.append((kind, source, f"{module}.{next(iter(known[head]))}", line(i)))
        elif head in imports:
            out.edges.append((kind, source, f"{imports[head]}.{tail}" if tail else imports[head], line(i)))
        else:
            out.unresolved.append((kind, source, name, line(i)))
    return out


def _python(module: str, text: str) -> Found:
    """Python's facts in the same form."""
    out = Found()
    for kind, value, line, _, _, detail in python_facts(module, text.encode()) or []:
        if kind.startswith("edge:"):
            out.edges.append((kind[5:], detail or "", value, line))
        elif kind == "signature":
            out.symbols.append(("definition", value, line, detail or ""))
    return out


Producer = Callable[[str, str], Found]


class Registry:
    """Producers by language. The languages known here are closed; others can be added once, by functions of (module, text)."""

    def __init__(self) -> None:
        self._own = {name: (lambda module, text, name=name: scan(name, module, text)) for name in _DEFINED} | {"python": _python}
        self._more: dict[str, tuple[tuple[str, ...], Producer]] = {}

    #: Endings by language.
    ENDINGS = {"python": (".py",), "javascript": (".js", ".mjs", ".cjs"), "typescript": (".ts", ".tsx"), "go": (".go",), "rust": (".rs",)}

    def register(self, language: str, endings: tuple[str, ...], producer: Producer) -> None:
        if language in self._own or language in self._more:
            raise ValueError(f"{language} has a producer")
        if not endings or not all(e.startswith(".") for e in endings) or not callable(producer):
            raise ValueError("a producer needs endings and a function")
        self._more[language] = (endings, producer)

    def languages(self) -> list[str]:
        return sorted([*self._own, *self._more])

    def of(self, path: str) -> tuple[str, Producer] | None:
        for language, endings in [*self.ENDINGS.items(), *((n, e) for n, (e, _) in self._more.items())]:
            if path.endswith(endings):
                return language, self._own.get(language) or self._more[language][1]
        return None


REGISTRY = Registry()
ROWS = pa.schema([("slug", pa.string()), ("path", pa.string()), ("language", pa.string()), ("entry", pa.string()), ("kind", pa.string()), ("source", pa.string()), ("target", pa.string()), ("line", pa.int32())])
ROWS_DDL = "slug string, path string, language string, entry string, kind string, source string, target string, line int"


def produced(files: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Symbols, edges and unresolved references of source files (slug, path, content): (slug, path, language, entry, kind, source, target, line).

    entry is symbol (source: qualified name, target: signature), edge or unresolved. Files of other languages, null contents and
    paths give no row; bytes that are no UTF-8 are replaced. Repeated rows count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for slug, path, data in zip(*(batch.column(c).to_pylist() for c in ("slug", "path", "content"))):
                if known := registry.of(path):
                    language, producer = known
                    found = producer(re.sub(r"\.\w+$", "", path).replace("/", "."), data.decode("utf-8", "replace"))
                    head = (slug, path, language)
                    rows += [(*head, "symbol", k, q, s, n) for k, q, n, s in found.symbols]
                    rows += [(*head, "edge", k, a, b, n) for k, a, b, n in found.edges]
                    rows += [(*head, "unresolved", k, a, b, n) for k, a, b, n in found.unresolved]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ROWS.types)], schema=ROWS)

    return files.where("path IS NOT NULL AND content IS NOT NULL").select("slug", "path", "content").mapInArrow(run, ROWS_DDL).distinct()
