import ast
import textwrap

import pytest
from conftest import rows

from pinloom.llm import foreign as X
from pinloom.llm import functions as N
from pinloom.llm import licenses as C
from pinloom.llm import parsing as P
from pinloom.llm.repair import induce

GOOD = {
    "python": ["", "x = [i async for i in y]\n", "match = 1\nmatch x:\n    case [1, *r] | {'a': -1+2j, **k} if r:\n        pass\n", "f'{x!r:>{w}}{{}}' r'' ", "def f(a, /, b=1, *, c, **d) -> int: ...\n", "with (a as b, c):\n\tpass\n", "type X[T: int] = list[T]\n", "print(*a, **b, c=1)\n", "lambda *a, b=1: (yield)\n", "try:\n  pass\nexcept* E as e:\n  pass\n"],
    "javascript": ["", "let a = b\n++c", "const f = async ({a = 1, ...r}, [b]) => a ?? (b || c)", "class A extends B { static #x = 1; get y() { return this.#x } static { f() } async *z() {} }", "a = `x${`${1}`}y` / 2; if (x) /re[/]/g.test(y)", "export default function () {}\nexport * as q from 'm'\nimport d, {a as b} from \"n\"", "for (const [k, v] of m) ;for (;;) break; do x(); while (0) y()", "x?.[1]?.(2) ; new.target; import.meta; await 1; 1_000n ** 2n", "label: for await (x of y) { continue label }", "({ get a() {}, async b() {}, [c]: 1, 'd'() {} })"],
    "go": ["package a\n", "package a\nimport (\n\t. \"x\"\n)\nfunc (r *T[K]) F(a, b int, c ...string) (x int, err error) { return }\n", "package a\nvar x = map[string][]int{\"a\": {1, 2}}\n", "package a\nfunc f() {\n\tif x := g(); x != (T{1}) {\n\t} else if y {\n\t}\n\tfor i := range 10 {\n\t}\n\tswitch v := x.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v, ok := <-c:\n\t}\n\tgo func() {}()\nL:\n\tgoto L\n}\n", "package a\ntype S[T ~int | string] struct {\n\tA, B int `x`\n\t*E\n}\ntype I interface {\n\tm(int) error\n\t~int | string\n}\n", "package a\nconst (\n\tA = iota\n\tB\n)\nfunc g[T any](x T) T { return h[int](x)[1:2:3] }\n"],
    "rust": ["", "fn f<'a, T: Clone + 'a>(x: &'a mut T) -> impl Fn(u8) -> Vec<Vec<u8>> where T: Sized { |y| vec![vec![y]] }", "impl<T> Tr for S<T> { const X: u8 = b'a'; fn m(&self) -> Self { Self { ..*self } } }", "fn main() { let Some(x) = y else { return }; if let Ok(a) | Err(a) = b { } match x { 0..=9 | -1 => {}, S { a, .. } if a => 1, _ => (), } for i in 0.. { break 'l 1; } 'l: loop {} }", "#[derive(A)]\npub(crate) enum E { A(u8), B { x: i32 } = 3, C }\nmacro_rules! m { ($x:expr) => { $x } }\nuse a::{b::*, c as _};", "fn f() { a >>= b; c = d >> 1 >= 2; x as u8 < y; let z = r#\"\"#; &&a; async move { q.await? }; <T as U>::v::<8>(); }", "trait T: U { type X; fn y() {} }\nstatic mut S: &[u8] = &[1; 3];\nextern \"C\" { fn z(a: *const u8, ...); }"],
    "json": ["{}", " [1, -0.5e+3, \"\\u00e9\", null] "],
    "toml": ["", "a.b = 1\n[x.y]\n'q' = [1, 2,\n]\n[[z]]\nd = 1979-05-27 07:32:00Z\ns = \"\"\"\nx\"\"\"\nt = {a = 1, b = []}\n", "f = [1e5, inf, 0x1F, true]\r\n"],
}
BAD = {
    "python": ["def f(:\n", "x = (1,\n", "print 'a'\n", "<<<<<<< HEAD\n", "if x:\npass\n", "\tx\n        y\n", "f() = 1\n", "'abc\n", "a b\n", "f'{'", "1abc\n", "x = 5 = y +\n", "f(a=1, 2)\n", "except:\n", "b'é'\n", "class A\n"],
    "javascript": ["function f( {", "let x: number = 1", "a b", "x = ;", "}", "'abc\n'", "if (x", "const z = { a: 1, b: };", "return => 1", "1 = x", "import x from y", "{% if x %}", "010", "class { }", "let a = `x", "with (a) b"],
    "go": ["", "func f() {}\n", "package a\nfunc f() { return\n", "package a\nvar x = \"open\n", "package a\nfunc f() { if x { } \n else { } }\n", "package a\nx := 1\n", "package a\nfunc f int { return }\n", "package a\nimport \"b\"\nfunc f() {}\nimport \"c\"\n"],
    "rust": ["fn f( {", "fn f() { let x = ; }", "struct S { a: }", "use x", "fn f() { } }", "let x = 1;", "fn f() { a b }", "/* open", "fn f() -> { }"],
    "json": ["", "{a: 1}", "[1,]", "{} x", "'a'", "[01]", "\ufeff{}", "{\"a\": 1, }", "\"\t\""],
    "toml": ["a = ", "[a", "a = 1\na = 2\n", "a = 'x", "a = 01", "= 1", "a b = 1", "name: x\n", "[t]\n[t]\n"],
}


def test_grammars():
    for language, texts in GOOD.items():
        for t in texts:
            out = P.parse(language, t.encode())
            assert out.valid, (language, t, out.cause, t[out.place :][:20])
    for language, texts in BAD.items():
        for t in texts:
            assert not P.parse(language, t.encode()).valid, (language, t)
    for t in GOOD["python"] + BAD["python"]:
        try:
            ast.parse(t)
            want = True
        except SyntaxError:
            want = False
        assert P.parse("python", t.encode()).valid == want, t
    assert P.parse("python", b"\xef\xbb\xbfx = 1\r\n").valid and P.parse("python", "# coding: latin-1\nx = 'é'\n".encode("latin-1")).valid
    assert P.parse("javascript", b"\xff").cause == "encoding" and P.parse("go", b"import os\nx = 1\ny = 2\n").cause == "other_language"
    assert P.parse("python", b"x = 1\n<<<<<<< a\ny\n=======\n").cause == "merge_conflict" and P.parse("rust", b"fn f() {").cause == "truncated"
    for text, want in (("x\\\n", False), ("\\\n", False), ("x = 1 + \\\n2\n", True), ("x\U000e0100 = 1\nका = x\u0301y\n", True), ("x = \u0301\n", False)):
        assert P.parse("python", text.encode()).valid == want, text
    deep = b"(" * 150 + b"1" + b")" * 150
    assert P.parse("python", deep).valid and P.parse("javascript", deep).valid and not P.parse("json", b"[" * 50_000).valid


FILES = "file_id long, slug string, commit_sha string, path string, package_scope string, content binary, _id string, language string"


def table(spark, files):
    return spark.createDataFrame([(i, "o/r", "c", p, s, c, "x", "y") for i, (p, s, c) in enumerate(files)], FILES)


def test_reports_and_rates(spark):
    df = table(spark, [("a.py", ".", b"x = (\n"), ("b.py", ".", b""), ("b.JS", ".", b"("), ("c.json", None, b""), ("d.go", ".", None)])
    df = df.unionByName(df)
    assert sorted((r.file_id, r.valid, r.cause) for r in P.parse_files(df).collect()) == [(0, False, "truncated"), (1, True, None), (3, False, "truncated")]
    rates = {r.language: (r.files, r.failed, r.rate) for r in P.failure_rates(P.parse_files(df)).collect()}
    assert rates == {"python": (2, 1, 0.5), "json": (1, 1, 1.0)}
    assert P.parse_files(df.limit(0)).count() == 0


PY = b'''class Base:
    def run(self):
        """Walks all rows of the table once."""
class Mid(Base):
    pass
class Leaf(Mid):
    def run(self):
        pass
    def other(self):
        """{@inheritDoc}"""
def load_rows(x):
    r"""Load rows.

    :param x: many words that do not count here at all
    """
def f():
    """

    Args:
        x: the number of things to keep
    """
    def inner():
        "One two three four"
'''
JS = b'''/** Reads the next five bytes. */
export async function read(a) {}
/** Reads the next five bytes. */
const go = (x) => x;
class A { /** Sums over all kept values. @param x y */
  static sum(x) {} }
/* Not a documentation comment at all. */
function no() {}
const s = "function fake() {}";
'''
GO = b"package a\n\n// Run walks all the rows.\n// Twice.\nfunc Run() {}\n\n// Detached comment of many words.\n\nfunc Not() {}\n\n// Len counts stored items quickly.\nfunc (s *T) Len() int { return 0 }\n"
RS = b"/// Counts kept rows of it.\n#[inline]\npub(crate) fn count() {}\n// plain words are no documentation\nfn plain() {}\nimpl T for S {\n    /** Builds another value from parts. */\n    unsafe fn make<X>() {}\n}\n"


def test_functions_with_documentation(spark):
    df = table(spark, [("a.py", ".", PY), ("b.js", ".", JS), ("c.go", ".", GO), ("d.rs", ".", RS), ("e.py", ".", b"def broken(:\n"), ("f.py", ".", None), ("g.py", ".", b"")])
    own = N.documented_functions(df, inherit=False).select("file_id", "start_line", "name")
    want = [(0, 2, "run"), (0, 22, "inner"), (1, 2, "read"), (1, 4, "go"), (1, 6, "sum"), (2, 5, "Run"), (2, 12, "Len"), (3, 3, "count"), (3, 8, "make")]
    assert rows(own) == sorted(want, key=repr)
    both = [(r.start_line, r.name, r.qualified_name, r.doc_source) for r in N.documented_functions(df).where("doc_source = 'inherited'").collect()]
    assert both == [(7, "run", "Leaf.run", "inherited")]
    assert N.documented_functions(df.limit(0)).count() == 0


def test_bases_are_found_by_module_and_import(spark):
    base = b'class Base:\n    def run(self):\n        """%s walks all rows of the table."""\n'
    files = [
        ("a/base.py", base % b"Alpha"), ("b/base.py", base % b"Beta"), ("b/leaf.py", b"from .base import Base as B\nclass Leaf(B):\n    def run(self):\n        pass\n"),
        ("c/leaf.py", b"import a.base\nclass Leaf(a.base.Base):\n    def run(self):\n        pass\n"), ("c/lost.py", b"class Lost(Base):\n    def run(self):\n        pass\n"), ("c/far.py", b"from elsewhere import Only\nclass Far(Only):\n    def go(self):\n        pass\n"),
        ("d/only.py", b'class Only:\n    def go(self):\n        """Only place that says what go does."""\n'), ("d/near.py", b"class Near(Only):\n    def go(self):\n        pass\n"),
        ("x/shape.js", b"export class Shape {\n  /** Draws the outline of this shape now. */\n  draw() {}\n}\n"), ("y/shape.js", b"export class Shape {\n  /** Another text about drawing some shape. */\n  draw() {}\n}\n"), ("y/box.js", b"import { Shape as S } from '../x/shape.js'\nclass Box extends S {\n  draw() {}\n}\n"),
        ("src/walk.rs", b"pub trait Walk {\n    /// Visits every node of the tree.\n    fn walk(&self);\n}\n"), ("src/tree.rs", b"use crate::walk::Walk;\nimpl Walk for Tree {\n    fn walk(&self) {}\n}\n"),
        ("g/one.go", b"package g\n\ntype A struct{}\n\n// Len counts stored items quickly.\nfunc (a A) Len() int { return 0 }\n"), ("g/two.go", b"package g\n\ntype B struct {\n\tA\n}\n\nfunc (b B) Len() int { return 1 }\n"),
    ]
    df = table(spark, [(p, ".", c) for p, c in files])
    out = {(r.file_id, r.name): r.docstring.split()[0] for r in N.documented_functions(df.unionByName(df)).where("doc_source = 'inherited'").collect()}
    # an import from elsewhere finds nothing, and so does a name that two modules hold
    assert out == {(2, "run"): "Beta", (3, "run"): "Alpha", (7, "go"): "Only", (10, "draw"): "Draws", (12, "walk"): "Visits", (14, "Len"): "Len"}


def test_toml_definitions_agree_with_the_standard_library():
    import random
    import tomllib

    rng = random.Random(5)
    keys = ["a", "b", "c", '"a"', "'b'", "a.b", "a.c", "b.a", "a.b.c", '"\\u0061"']
    values = ["1", "[1, 2]", "{a=1}", "{a.b=1, a.c=2}", "{a=1,a=2}", "[{a=1},{b=2}]", "{}", "2020-02-30", "1979-05-27T07:32:00Z", "25:00:00", "2020-02-29", "{a.b=1,a=2}", "[[1],{a={b=1}}]"]
    for _ in range(4000):
        lines = []
        for _ in range(rng.randint(1, 7)):
            r, k = rng.random(), rng.choice(keys)
            lines.append(f"[{k}]" if r < 0.25 else f"[[{k}]]" if r < 0.4 else f"{k} = {rng.choice(values)}")
        text = "\n".join(lines) + "\n"
        try:
            tomllib.loads(text)
            want = True
        except tomllib.TOMLDecodeError:
            want = False
        assert P.parse("toml", text.encode()).valid == want, text


def test_name_words():
    assert not N.described("The proposal palette.", "attach_proposal_palette") and N.described("Returns all kept rows.", "getX")
    assert not N.described("Reads HTTP data", "readHTTPData") and N.described("one two three four\n@param x", "f") and not N.described("# Arguments\none two three four five", "f")


def test_grammar_induction():
    import numpy as np

    g = induce([np.array([1, 2] * 50, dtype=np.uint64), np.arange(100, dtype=np.uint64), np.zeros(0, np.uint64), np.full(64, 7, np.uint64)])
    alone = induce([np.array([1, 2] * 50, dtype=np.uint64)])
    assert g.start_rule[0] == alone.start_rule[0] and len(set(g.start_rule.tolist())) == 4
    assert g.size()[0] < 0.3 and g.size()[1] == 1.0 and g.size()[2] == 0 and g.size()[3] < 0.4 and g.rules[1] == 0


def test_foreign_files(spark):
    body = b"def f(x):\n    return x + 1\n"
    long = b";".join(b"var a%d=f(%d,b)" % (i, i) for i in range(80))
    files = [("a.py", b"# Code generated by x. DO NOT EDIT.\n" + body), ("b.py", body + b"NOTE = '@generated'\n"), ("c.js", long), ("vendor/d.py", body), ("vendor_tool/e.py", body), ("f.py", b"X = [\n" + b"    1, 2, 3, 4,\n" * 20 + b"]\n"), ("g.py", body + b"\n# machine-made by z, do not modify\n"), ("h.py", b"def ("), ("i.go", b"// not generated by hand-made tools\npackage a\n"), ("j.py", b""), ("k.md", b"@generated"), ("l.py", None), ("m.py", b"# Vendored from x-1.2, see its own repository.\n" + body)]
    df = table(spark, [(p, ".", c) for p, c in files])
    out = {r.file_id: r["class"] for r in X.foreign_files(df.unionByName(df)).collect()}
    assert out == {0: "generated", 1: "hand-written", 2: "minified", 3: "vendored", 4: "hand-written", 5: "data", 6: "generated", 7: "invalid", 8: "hand-written", 9: "hand-written", 12: "vendored"}
    assert X.shared_rules(df).count() == 10 and X.foreign_files(df.limit(0)).count() == 0 and X.shared_rules(df.limit(0)).count() == 0
    assert {r.file_id for r in X.foreign_files(df, judge_all=False).where("class NOT IN ('hand-written', 'invalid')").collect()} == {0, 2, 3, 5, 6, 12}


HAND = b"""import json


def load(path, limit=10):
    rows = []
    with open(path) as f:
        for line in f:
            if len(rows) >= limit:
                break
            rows.append(json.loads(line))
    return rows


class Store:
    def __init__(self, rows):
        self.rows, self.seen = rows, set()

    def fresh(self, key):
        if key in self.seen:
            raise KeyError(key)
        self.seen.add(key)
        return [r for r in self.rows if r.get(key) is not None and not r[key].startswith("_")]
"""


def test_vague_notes_need_a_grammar_that_agrees(spark):
    import base64
    import random

    blob = base64.b64encode(random.Random(1).randbytes(24_000))
    small = b"\n".join(b"function f%d(a,b){var c=a.x%d;if(c>b){c=g(c,b)}return c&&b.y||%d}" % (i, i, i) for i in range(40))
    accessors = b"".join(b"class A%d:\n    def __init__(self, value):\n        self._value = value\n\n    def get_a%d(self):\n        return self._value\n\n    def set_a%d(self, value):\n        self._value = value\n\n" % (i, i, i) for i in range(8))
    prose = b'"""' + b"This module tells how rows are kept. " * 40 + b'"""\n'
    files = [("a.py", b"# Adapter for the third-party billing API.\n" + HAND), ("b.py", b"# Parses reports generated by the billing job.\n" + HAND), ("c.py", b"# Callers do not change the rows they get.\n" + HAND)]
    files += [("d.py", b"DATA = '" + blob + b"'\n"), ("e.js", small), ("f.py", accessors), ("g.py", prose), ("h_pb2.py", HAND), ("i.py", b"import base64\nDATA = base64.b64decode('" + blob + b"')\n"), ("j.py", b"# Do not change the order of these rows.\n" + HAND), ("k.py", HAND.replace(b"json", b"csv")), ("l.py", b"def f():\n    return 1\n\n\nICON = 'M" + b" ".join(b"%d,%d" % (i * 7 % 997, i * 31 % 991) for i in range(60)) + b"'\n")]
    rows_ = [(i, "o/r", p, c) for i, (p, c) in enumerate(files)]
    # the same words over a copy of what another repository holds
    rows_ += [(20, "x/y", "z.py", b"# third-party helper, see upstream\n" + HAND.replace(b"rows", b"cells")), (21, "o/r", "z.py", HAND.replace(b"rows", b"cells"))]
    df = spark.createDataFrame(rows_, "file_id long, slug string, path string, content binary")
    out = {r.file_id: (r["class"], r.decided_by) for r in X.foreign_files(df).collect()}
    hand = ("hand-written", "")
    assert out == {0: hand, 1: hand, 2: hand, 3: ("data", "literals"), 4: ("minified", "spacing"), 5: ("generated", "reused rules"), 6: hand, 7: ("generated", "name"), 8: ("data", "literals"), 9: hand, 10: hand, 11: hand, 20: ("vendored", "shared rules"), 21: hand}


def test_statements_name_licences():
    model = C.train()
    for text, want in [("SPDX-License-Identifier: (MIT OR ISC)", ["ISC OR MIT"]), ("Licensed under the Grumble Public License, version 3", []), ("All rights reserved. See the website.", []), ("Reused under the terms of the GNU General Public License,\nversion 2 or later, as told.", ["GPL-2.0-or-later"]), ("", []), ("MIT licence\n\nBSD 3-Clause licence", ["BSD-3-Clause", "MIT"]), ("choose the Apache License 2.0 or the GNU GPL version 2 or any later version", ["Apache-2.0 OR GPL-2.0-or-later"])]:
        assert C.named_licences(text, model) == want, text


def test_licence_texts_without_a_title():
    model = C.train()
    for spdx, bodies in C.all_bodies().items():
        for body in bodies:
            wrapped = "Copyright (c) 1998 Jane Doe and others\n\n" + "\n".join(textwrap.wrap(body, 61))
            assert C.named_licences(wrapped, model) == [spdx], spdx
            assert C.named_licences(f"{spdx} License\n\n" + wrapped, model) == [spdx], spdx
    long = "Grant of rights. Every licensee may copy the work, see also the GNU Affero General Public License version 3.\n" * 40
    assert C.named_licences("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + long, model) == ["GPL-3.0-only"]
    for text, want in [
        ("This is not under the MIT License.", []), ("formerly MIT licence", []), ("SPDX-License-Identifier: MIT AND Apache-2.0", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
        ("GNU General Public License v2 or later with the Classpath exception", ["GPL-2.0-or-later WITH Classpath-exception-2.0"]), ("SPDX-License-Identifier: EPL-1.0", ["EPL-1.0"]), ("Licensed under the Artistic License 2.0", ["Artistic-2.0"]), ("Mozilla Public License 1.1", ["MPL-1.1"]),
        ("see W3C standard", []), ("connects to PostgreSQL", []), ("Python 2.0 or later", []), ("Released under the BSD license", []), ("It walks the tree of rows and never stops before the last of them was seen by the caller who asked for it", []),
    ]:
        assert C.named_licences(text, model) == want, text


def test_held_out_names():
    """Templates that the training texts don't hold."""
    model = C.train()
    right = [model.classify(t.format(n)) == s for s, names in C.all_names().items() for n in names[:6] for t in ("Terms are those of the {0} as published", "We ship all of this under {0}", "{0} applies to every file below")]
    assert sum(right) / len(right) >= 0.9


EVIDENCE = "slug string, commit_sha string, source_path string, canonical_expression string, status string, _repo string"


def test_licences_along_paths(spark):
    mit, isc = b"SPDX-License-Identifier: MIT\n", b"ISC licence\n"
    files = [("LICENSE", ".", mit), ("p/COPYING.txt", "p", isc), ("a.py", None, b"x = 1\n"), ("p/b.py", "p", b"\n"), ("p/c.go", "p", b"// Licensed under the Unlicense.\npackage c\n"), ("q/d.rs", "q/", b""), ("q/d.rs.license", "q", isc + b"\nMIT\n"), ("e.js", ".", b"/* All rights reserved */"), ("q/f.py", "q", b'"""doc"""\nS = "SPDX-License-Identifier: ISC"\n'), ("g.py", ".", None)]
    told = [("o/r", "c", "e.js", "apache 2.0", "selected", ""), ("o/r", "c", "a.py", "ISC", "shadowed", ""), ("o/r", "z", "a.py", "ISC", "selected", ""), ("o/r", "c", None, None, "selected", "")]
    df = table(spark, files)
    out = {r.record_key: (r.subject, r.expression, r.state, r.source) for r in C.resolved_licences(df.unionByName(df), spark.createDataFrame(told, EVIDENCE)).collect()}
    assert out["2"] == ("file", "MIT", "resolved", "scope") and out["3"] == ("file", "ISC", "resolved", "scope") and out["4"] == ("file", "Unlicense", "resolved", "head")
    assert out["5"] == ("file", "", "conflict", "beside") and out["7"] == ("file", "Apache-2.0", "resolved", "evidence") and out["8"][1:] == ("MIT", "resolved", "top") and out["9"][1] == "MIT"
    assert out["o/r@c"] == ("repository", "MIT", "resolved", "top") and len(out) == 8
    assert C.resolved_licences(df.limit(0), spark.createDataFrame([], EVIDENCE)).count() == 0


def test_toml_headers_of_many_parts():
    for t in ("[[a.b.c.d.e]]\nx = 1\n", "[[a . 'b' . \"c\".d.e.f.g.h]]\n[[p.q]] # y\n[z]\nq = [[1], [[2]]]\n"):
        assert P.parse("toml", t.encode()).valid, t
    for t in ("[[a.b.c.d.e]\n", "[[a]\n[b]]\n", "[a]]\n", "[[a.b.c.d.e]]]\n"):
        assert not P.parse("toml", t.encode()).valid, t

def test_inherited_documentation_of_a_deep_chain(spark):
    depth = 34
    code = "class C0:\n    def run(self):\n        \"\"\"Carries every parcel across the river.\"\"\"\n"
    code += "".join(f"class C{i}(C{i - 1}):\n    pass\n" for i in range(1, depth)) + f"class C{depth}(C{depth - 1}):\n    def run(self):\n        pass\n"
    code += "class D(E):\n    def go(self):\n        pass\nclass E(D):\n    def go(self):\n        pass\n"  # a cycle
    df = spark.createDataFrame([(1, "o/r", "c", "a.py", bytearray(code.encode()))], "file_id long, slug string, commit_sha string, path string, content binary")
    out = [(r.qualified_name, r.doc_source, r.docstring) for r in N.documented_functions(df).collect()]
    assert sorted(out) == [("C0.run", "own", "Carries every parcel across the river."), (f"C{depth}.run", "inherited", "Carries every parcel across the river.")]


def rows_of_last_query(spark):
    """The most rows that any step of the last query gave."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    last = store.executionsList().last().executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    found = [0]
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for k in range(metrics.size()):
            m = metrics.apply(k)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(found)


def test_licences_are_not_copied_for_every_task(spark):
    """copies of the licences of each directory grew with the number of tasks, unseen by the optimizer that broadcast them."""
    mit, isc = b"SPDX-License-Identifier: MIT\n", b"ISC licence\n"
    files = [("LICENSE", ".", mit), ("p/COPYING", "p", isc)] + [(f"{d}f{i}.py", d.strip("/"), b"x = 1\n") for d in ("", "p/", "q/") for i in range(10)]
    df, none = table(spark, files), spark.createDataFrame([], EVIDENCE)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        out = C.resolved_licences(df, none).collect()
        assert 30 <= rows_of_last_query(spark) <= 4 * len(files)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.expression, r.source) for r in out) == sorted([("MIT", "scope")] * 10 + [("ISC", "scope")] * 10 + [("MIT", "top")] * 11)


def test_licences_of_large_directories(spark, monkeypatch):
    files = [("LICENSE", ".", b"SPDX-License-Identifier: MIT\n"), ("p/COPYING", "p", b"ISC licence\n")] + [(f"{d}f{i}.py", d.strip("/"), b"x = 1\n") for d in ("", "p/", "q/") for i in range(10)]
    df, none = table(spark, files), spark.createDataFrame([], EVIDENCE)
    want = rows(C.resolved_licences(df, none))
    for size in (1, 3, 10):
        monkeypatch.setattr(C, "PART_FILES", size)
        assert rows(C.resolved_licences(df.unionByName(df), none)) == want
