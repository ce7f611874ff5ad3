"""Facts about source files: definitions, references, calls, imports and graph edges of Python; snippets and their classes."""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinloom.sources.blobs import lines_of

_FACTS = [("slug", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("line", pa.int32()), ("start_col", pa.int32()), ("end_col", pa.int32()), ("detail", pa.string())]
FACTS = pa.schema(_FACTS)
FACTS_DDL = "slug string, path string, kind string, value string, line int, start_col int, end_col int, detail string"
Fact = tuple[str, str, int, int, int, str | None]


def dotted(node: ast.expr) -> str | None:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


class Facts(ast.NodeVisitor):
    """Walks a module and notes what its syntax says, with the scope a name is looked up in."""

    def __init__(self, module: str) -> None:
        self.module, self.out = module, []
        self.scopes: list[tuple[str, dict[str, set[str]], bool]] = [(module, {}, False)]  # name, bindings, whether a class
        self.handled: list[list[str]] = []
        self.called: set[int] = set()

    def note(self, kind: str, value: str, node: ast.AST, detail: str | None = None) -> None:
        self.out.append((kind, value, node.lineno, node.col_offset, node.end_col_offset, detail))

    def here(self) -> str:
        return self.scopes[-1][0]

    def bind(self, name: str, target: str) -> None:
        self.scopes[-1][1].setdefault(name, set()).add(target)

    def collect(self, body: list[ast.stmt]) -> None:
        """The bindings of a scope are known before its statements run."""
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.bind(s.name, f"function:{self.here()}.{s.name}")
            elif isinstance(s, ast.ClassDef):
                self.bind(s.name, f"class:{self.here()}.{s.name}")
            elif isinstance(s, ast.Import):
                for a in s.names:
                    self.bind(a.asname or a.name.split(".")[0], f"module:{a.name if a.asname else a.name.split('.')[0]}")
            elif isinstance(s, ast.ImportFrom):
                for a in s.names:
                    self.bind(a.asname or a.name, f"external:{'.' * s.level}{s.module or ''}.{a.name}")
            elif isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    for n in ast.walk(t):
                        if isinstance(n, ast.Name):
                            self.bind(n.id, f"constant:{self.here()}.{n.id}")
            elif isinstance(s, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                if isinstance(s, ast.For):
                    for n in ast.walk(s.target):
                        if isinstance(n, ast.Name):
                            self.bind(n.id, f"local:{self.here()}.{n.id}")
                for part in ("body", "orelse", "finalbody"):
                    self.collect(getattr(s, part, []))
                for h in getattr(s, "handlers", []):
                    self.collect(h.body)

    def lookup(self, name: str) -> tuple[str, str] | None:
        """(kind, target) of the one binding of a name, seen from the inside out; class scopes only from themselves."""
        for i in range(len(self.scopes) - 1, -1, -1):
            _, bound, is_class = self.scopes[i]
            if name in bound and (not is_class or i == len(self.scopes) - 1):
                targets = bound[name]
                if len(targets) > 1:
                    return "ambiguous", name
                kind, _, target = next(iter(targets)).partition(":")
                return kind, target
        return None

    def edge(self, kind: str, node: ast.expr) -> None:
        name = dotted(node)
        if name is None:
            self.note("unresolved", kind, node, self.here())
            return
        head, _, rest = name.partition(".")
        found = self.lookup(head)
        if found is None:
            if not hasattr(builtins, head):
                self.note("unresolved", name, node, self.here())
            return
        what, target = found
        if what == "ambiguous" or (rest and what != "module") or (what == "module" and not rest) or what in ("constant", "local", "parameter"):
            self.note("unresolved", name, node, self.here())
            return
        if kind == "calls" and what == "class":
            kind = "instantiates"
        self.note(f"edge:{kind}", f"{target}.{rest}" if rest else target, node, self.here())

    def visit_Module(self, node: ast.Module) -> None:
        self.collect(node.body)
        self.generic_visit(node)

    def scope(self, node, is_class: bool) -> None:
        self.scopes.append((f"{self.here()}.{node.name}", {}, is_class))
        if not is_class:
            a = node.args
            for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]:
                self.bind(x.arg, f"parameter:{self.here()}.{x.arg}")
        self.collect(node.body)
        for s in node.body:
            self.visit(s)
        self.scopes.pop()

    def visit_FunctionDef(self, node) -> None:
        self.note("symbol_definition", node.name, node, ast.unparse(node.args))
        self.note("signature", f"{node.name}({ast.unparse(node.args)})", node, self.here())
        for d in node.decorator_list:
            self.visit(d)
        for d in [*node.args.defaults, *[x for x in node.args.kw_defaults if x]]:
            self.visit(d)
        self.scope(node, False)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.note("symbol_definition", node.name, node, None)
        for b in node.bases:
            self.edge("inherits", b)
            self.visit(b)
        for d in node.decorator_list:
            self.visit(d)
        self.scope(node, True)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.note("import", a.name, node, a.asname)
            self.note("edge:imports", a.name, node, self.here())

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            full = f"{'.' * node.level}{node.module or ''}.{a.name}"
            self.note("import", full, node, a.asname)
            self.note("edge:imports", full, node, self.here())

    def visit_Call(self, node: ast.Call) -> None:
        if name := dotted(node.func):
            self.note("call", name, node.func, None)
        self.edge("calls", node.func)
        self.called.add(id(node.func))
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        target = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
        if target is not None:
            self.edge("raises", target)
        elif self.handled and len(self.handled[-1]) == 1:
            self.note("edge:raises", self.handled[-1][0], node, self.here())
        else:
            self.note("unresolved", "raise", node, self.here())
        self.generic_visit(node)

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        types = node.type.elts if isinstance(node.type, ast.Tuple) else [node.type] if node.type else []
        self.handled.append([t for t in (dotted(x) for x in types) if t])
        self.generic_visit(node)
        self.handled.pop()

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            found = self.lookup(node.id)
            self.note("symbol_reference", node.id, node, found[0] if found else "builtin" if hasattr(builtins, node.id) else "unknown")
            if found and found[0] in ("constant", "function", "class", "external") and id(node) not in self.called:
                self.note("edge:reads", found[1], node, self.here())
        else:
            self.note("symbol_definition", node.id, node, "assignment")


def python_facts(module: str, data: bytes) -> list[Fact] | None:
    """The facts of one file; null if it does not parse."""
    try:
        visitor = Facts(module)
        visitor.visit(ast.parse(data))
        return visitor.out
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def fact_table(files: DataFrame) -> DataFrame:
    """Facts of Python files (slug, path, content): kind, value, line, columns and a detail; one parser_unavailable row for a file that does not parse.

    Kinds: symbol_definition, symbol_reference (detail: what the name is bound to), signature, import, call, unresolved, and
    edge:imports, edge:inherits, edge:calls, edge:instantiates, edge:reads, edge:raises (value: the target, detail: the source).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for slug, path, data in zip(*(batch.column(c).to_pylist() for c in ("slug", "path", "content"))):
                module = path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")
                found = python_facts(module, data or b"")
                rows += [(slug, path, "parser_unavailable", "", 1, 0, 0, None)] if found is None else [(slug, path, *f) for f in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FACTS.types)], schema=FACTS)

    return files.where(F.col("path").endswith(".py")).select("slug", "path", "content").mapInArrow(run, FACTS_DDL)


def fenced_snippets(content: Column) -> Column:
    """The fenced code blocks of a Markdown text: array of (line, language, code); unclosed and blank ones are dropped."""
    lines = lines_of(content)
    marks = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^[ ]{0,3}```"), i)), lambda i: i.isNotNull())
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(marks) / 2).cast("int") - 1, F.lit(0))), lambda k: F.struct(F.get(marks, k * 2).alias("a"), F.get(marks, k * 2 + 1).alias("b")))
    whole = F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    code = lambda p: F.array_join(F.slice(lines, p["a"] + 2, p["b"] - p["a"] - 1), "\n")
    blocks = F.transform(whole, lambda p: F.struct((p["a"] + 2).alias("line"), F.lower(F.regexp_extract(F.get(lines, p["a"]), r"```\s*([\w+#.-]*)", 1)).alias("language"), code(p).alias("code")))
    return F.filter(blocks, lambda b: F.trim(b["code"]) != "")


#: Path parts and words that tell what an example shows.
PATHS = {"test": ("test", "tests"), "integration": ("e2e", "integration", "integration_test", "integration_tests"), "benchmark": ("bench", "benches", "benchmark", "benchmarks"), "internal": ("internal", "private"), "production": ("prod", "production")}
WORDS = {"deprecated": ("deprecated", "deprecation"), "benchmark": ("bench", "benchmark", "criterion"), "error": ("catch", "except", "rescue", "try"), "configuration": ("config", "configuration", "configure", "env", "environment", "option", "options", "settings")}


def example_labels(path: Column, code: Column, symbols: Column) -> Column:
    """What an example shows, as sorted labels; ``unknown`` if nothing tells."""
    words = F.array_union(F.split(F.lower(path), "/"), F.regexp_extract_all(F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")), F.lit("([a-z0-9]+)"), F.lit(1)))
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    tokens = F.transform(F.regexp_extract_all(code, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), lambda x: F.lower(x))
    in_path = lambda k: F.arrays_overlap(words, F.array(*[F.lit(x) for x in PATHS[k]]))
    in_code = lambda k: F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in WORDS[k]]))
    test = in_path("test") | name.startswith("test_") | name.endswith("_test.py")
    place = F.when(test & in_path("integration"), "integration_test").when(test, "unit_test").when(in_path("production"), "production_usage").when(F.array_contains(words, "docs") | F.array_contains(words, "examples") | name.startswith("readme"), "minimal_usage")
    private = F.exists(symbols, lambda s: F.element_at(F.split(s, r"\."), -1).startswith("_"))
    labels = F.array_sort(F.array_compact(F.array(
        place, F.when(in_code("error"), "error_handling"), F.when(in_code("configuration"), "configuration"), F.when(in_path("benchmark") | in_code("benchmark"), "benchmark"),
        F.when(in_path("internal") | private, "internal_only_usage"), F.when(F.array_contains(words, "deprecated") | in_code("deprecated"), "deprecated_example"),
    )))
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("unknown")))


def mentioned(code: DataFrame, keys: list[str], text: str, symbols: DataFrame) -> DataFrame:
    """Which symbols (symbol) occur in the texts at identifier boundaries: the keys and an ordered array of symbols.

    Texts are cut into identifiers and their dotted chains, which meet the symbols in an equi-join.
    """
    chains = F.regexp_extract_all(F.col(text), F.lit(r"((?<![\w$.])[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)"), F.lit(1))
    parts = F.transform(chains, lambda c: F.split(c, r"\."))
    runs = F.flatten(F.transform(parts, lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.size(p)), lambda a: F.transform(F.sequence(a, F.size(p)), lambda b: F.array_join(F.slice(p, a, b - a + 1), "."))))))
    tokens = code.select(*keys, F.explode(F.array_distinct(runs)).alias("symbol"))
    return tokens.join(symbols.select("symbol").distinct(), "symbol", "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
