import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pinloom.functions import scalars as S
from pinloom.functions.spdx import canonical
from pinloom.operators import diff as D
from pinloom.operators import graph as G
from pinloom.operators import overlap as O
from pinloom.operators import scores as C
from pinloom.operators import symbols as Y
from pinloom.operators.discovery import verified_candidates
from pinloom.sources.manifests import dependency_edges, edges_of


def test_similar_spans_agree_with_all_pairs(spark):
    rng = random.Random(1)
    for threshold in (5000, 8000, 10000):
        data = [("g", s, s + rng.choice([0, 1, 3, 9, 20, 21, 22, 40])) for s in (rng.randrange(60) for _ in range(120))]
        got = {(r.a_start, r.a_end, r.b_start, r.b_end) for r in O.similar_spans(spark.createDataFrame(data, "k string, s long, e long"), ["k"], "s", "e", threshold).collect()}
        want = set()
        for a, b in itertools.combinations(sorted({x[1:] for x in data}), 2):
            o = max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1)
            if o * 10000 >= (a[1] - a[0] + 1 + b[1] - b[0] + 1 - o) * threshold:
                want.add((*a, *b))
        assert got == want


def test_line_union(spark):
    data = [("a", 1, 3), ("a", 2, 5), ("a", 7, 7), ("a", 1, 3), ("a", 9, 8), ("b", 1, 1)]
    assert rows(O.line_union(spark.createDataFrame(data, "k string, s int, e int"), ["k"], "s", "e")) == [("a", 6), ("b", 1)]


def test_namespaces(spark):
    ours, theirs = spark.createDataFrame([("a.b",), ("c",), ("dd",)], "n string"), spark.createDataFrame([("a",), ("c.d",), ("d",)], "n string")
    assert rows(O.namespace_conflicts(ours, theirs, "n")) == [("a.b",), ("c",)]


def test_graph_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x"), ("b", "b")], "src string, dst string")
    seed = spark.createDataFrame([("a",), (None,)], "node string")
    assert rows(G.reachable(e, seed)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(G.reachable(e, seed.limit(0))) == []
    assert rows(G.shortest_paths(e, seed, 5)) == [("a", "b", 1, "a>b"), ("a", "c", 2, "a>b>c"), ("a", "d", 3, "a>b>c>d")]
    with pytest.raises(ValueError):
        G.shortest_paths(e, seed, 2)
    kinds = e.withColumn("kind", F.lit("calls"))
    rules = spark.createDataFrame([("b", "include"), ("c", "external")], "node string, disposition string")
    assert rows(G.closure(kinds, seed, ["calls"], rules)) == [("a", 0, "include"), ("b", 1, "include"), ("c", 2, "external")]


def test_diffs(spark):
    a, b = spark.createDataFrame([("p", "1"), ("q", None), ("r", "3")], "k string, v string"), spark.createDataFrame([("p", "2"), ("q", None), ("s", "4")], "k string, v string")
    assert rows(D.tree_diff(a, b, ["k"], "v")) == [("p", "modified"), ("r", "removed"), ("s", "added")]
    assert D.same_rows(a, a) and not D.same_rows(a, b)
    hits = [("s", "c", "p", "1"), ("s", "c", "p", "2"), ("s", "d", "p", "1"), ("t", "c", "p", "1"), ("t", "c", "q", "9")]
    h = spark.createDataFrame(hits, "slug string, commit_sha string, path string, blob_sha string")
    assert rows(D.dedup_hits(h)) == [("s", "c", "p", "1", 2), ("t", "c", "q", "9", 1)]


def test_promotion_and_budget(spark):
    from pinloom.functions.digests import git_blob_sha

    text = spark.createDataFrame([("s", "c", "p", "bad"), ("t", "c", "p", "good"), ("u", "c", "p", "other")], "slug string, commit_sha string, path string, content string")
    sha = {r[0]: r[1] for r in spark.range(1).select(F.explode(F.array(F.lit("good"), F.lit("other"))).alias("t")).select("t", git_blob_sha(F.encode("t", "UTF-8"))).collect()}
    hits = spark.createDataFrame([("s", "c", "p", sha["good"]), ("t", "c", "p", sha["good"]), ("u", "c", "p", sha["other"]), ("v", "c", "p", "0" * 40)], "slug string, commit_sha string, path string, blob_sha string")
    out = {r.slug: (r.attempts, r.state) for r in verified_candidates(hits, text, 10).collect()}
    assert out == {"t": (2, "verified"), "u": (1, "verified"), "v": (1, "failed")}
    assert {r.slug: r.state for r in verified_candidates(hits, text, 2).collect()} == {"t": "verified", "u": "not_attempted", "v": "not_attempted"}


def test_scores(spark):
    checks = spark.createDataFrame([("a", "pass", 10000, 1), ("a", "fail", 0, 1), ("a", "unknown", None, 2), ("b", "not_applicable", None, 1), ("c", "pass", 3333, 3)], "g string, status string, score_bps long, weight long")
    out = {r.g: tuple(r)[1:] for r in C.weighted_bounds(checks, ["g"]).collect()}
    assert out["a"] == (4, 2, None, 5000, 2500, 7500) and out["b"] == (0, 0, None, None, None, None) and out["c"] == (3, 3, 3333, 3333, 3333, 3333)
    assert {r.g: r.verdict for r in C.gate_verdict(checks, ["g"], F.lit(True)).collect()} == {"a": "fail", "b": "pass", "c": "pass"}
    c = spark.createDataFrame([(1, 5, 1), (2, 5, None), (3, 4, 9)], "k long, a int, b int")
    out = {r.role: (r.status, r.winner) for r in C.lexicographic_winners(c, "k", {"a": [F.col("a")], "ab": [F.col("a"), F.col("b")]}).collect()}
    assert out == {"a": ("equal_identity_tiebreak", 1), "ab": ("unranked_incomparable", None)}


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).collect()[0].x
    assert get(S.ratio_bps(F.lit(1), F.lit(3))) == 3333 and get(S.ratio_bps(F.lit(2), F.lit(3))) == 6667 and get(S.ratio_bps(F.lit(1), F.lit(0))) is None
    assert get(S.normal_package(F.lit("A__b.-C"))) == "a-b-c" and get(S.escaped_module(F.lit("github.com/Azure/X"))) == "github.com/!azure/!x"
    assert get(S.version_parts(F.lit("v1.10.2"))) == [1, 10, 2] and get(S.version_parts(F.lit("1.x"))) is None
    assert get(S.redacted(F.lit("token=abc https://u:p@h/ Bearer xyz"))) == "token=[redacted] https://[redacted]@h/ Bearer [redacted]"
    assert get(S.module_name(F.lit("src/a/b/__init__.py"))) == "a.b"
    assert get(S.pinned_commit(F.lit("http://x?ref=" + "a" * 40), F.lit("http://y/blob/" + "a" * 40 + "/f"))) == "a" * 40
    assert get(S.canonical_language(F.lit("PyPI"))) == "python"


def test_spdx():
    assert canonical("mit OR (Apache-2.0 AND  isc)") == "MIT OR Apache-2.0 AND ISC"
    assert canonical("(MIT OR ISC) AND BSD-3-Clause") == "(MIT OR ISC) AND BSD-3-Clause"
    assert canonical("((MIT))") == "MIT" and canonical("GPL-2.0-only WITH Classpath-exception-2.0") == "GPL-2.0-only WITH Classpath-exception-2.0"
    for bad in ("", "MIT OR", "FOO", "(MIT", "MIT ISC", "MIT WITH ISC", "AND"):
        assert canonical(bad) is None


def test_manifests(spark):
    assert edges_of("Cargo.lock", '[[package]]\nname = "a"\nversion = "1"\n[[package]]\nname = "b"\nversion = "2"\nsource = "r"\nchecksum = "c"\n')[1] == [("crates", "b", "2", "c", "b@2")]
    assert edges_of("go.mod", "module m\nrequire (\n\tx/y v1.2.3 // indirect\n\tbad\n)\nrequire z v0.0.0-20200101000000-abcdefabcdef\n") == ("complete", [("go", "x/y", "v1.2.3", None, "x/y@v1.2.3"), ("go", "z", "v0.0.0-20200101000000-abcdefabcdef", "abcdefabcdef", "z@v0.0.0-20200101000000-abcdefabcdef")], [("line:4", "malformed")])
    assert edges_of("requirements.txt", "A_b==1.0\n# c\nx>=2\n") == ("direct-only", [("pypi", "a-b", "1.0", None, "a-b==1.0")], [("line:3", "unsupported")])
    lock = '{"lockfileVersion": 3, "packages": {"": {}, "node_modules/@s/a": {"version": "1", "integrity": "i"}, "x": {"version": "1"}}}'
    assert edges_of("package-lock.json", lock)[1:] == ([("npm", "@s/a", "1", "i", "@s/a@1")], [("packages.x", "unsupported")])
    assert edges_of("package.json", "{")[2] == [("", "malformed")]
    files = spark.createDataFrame([("s", "c", "d/requirements.txt", b"a==1\na==1\n"), ("s", "c", "package.json", None)], "slug string, commit_sha string, path string, content binary")
    assert dependency_edges(files).count() == 2


def test_python_facts():
    text = b"import os, a.b as q\nfrom m import E, f\nclass B(E):\n    def g(self, x=f()):\n        raise E('x')\n    def h(self):\n        os.path.join(self)\n        self.g()\n        return B()\ntry:\n    f()\nexcept E:\n    raise\n"
    facts = Y.python_facts("mod", text)
    edges = {(k.removeprefix("edge:"), v, d) for k, v, *_, d in facts if k.startswith("edge:")}
    assert {("inherits", "m.E", "mod"), ("raises", "m.E", "mod.B.g"), ("calls", "os.path.join", "mod.B.h"), ("instantiates", "mod.B", "mod.B.h"), ("calls", "m.f", "mod"), ("raises", "E", "mod")} <= edges
    assert ("unresolved", "self.g") in {(k, v) for k, v, *_ in facts} and Y.python_facts("m", b"def") is None


def test_snippets_and_examples(spark):
    text = "a\n```py\nx = try_it(foo.bar)\n```\n```\n\n```\n```js\nopen"
    df = spark.createDataFrame([(1, "docs/README.md", text), (2, "x.md", ""), (3, None, None)], "id int, path string, t string")
    out = df.select("id", "path", F.inline(Y.fenced_snippets(F.col("t"))))
    assert rows(out) == [(1, "docs/README.md", 3, "py", "x = try_it(foo.bar)")]
    symbols = spark.createDataFrame([("foo.bar",), ("bar",), ("try",)], "symbol string")
    assert rows(Y.mentioned(out, ["id"], "code", symbols)) == [(1, ["bar", "foo.bar"])]
    labels = spark.range(1).select(Y.example_labels(F.lit("tests/integration/a_test.py"), F.lit("try: config"), F.array(F.lit("m._x"))).alias("l")).collect()[0].l
    assert labels == ["configuration", "error_handling", "integration_test", "internal_only_usage"]
