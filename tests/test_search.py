import random
import re

import pytest
from conftest import rows

from pinloom.functions.digests import git_blob_sha, tree_digests
from pinloom.operators import predicates as P
from pinloom.operators import ranking as R
from pinloom.operators import trigram as T
from pinloom.plans.search import LARGE, search
from pinloom.plans.spec import Predicate, Scope, SearchSpec, SpecError, translation
from pinloom.sources.blobs import line_rows, scan_tree
from pyspark.sql import functions as F

SCHEMA = "slug string, commit_sha string, path string, blob_sha string, size long, content string, language string, _hits string"
SHA = "a" * 40


def blobs(spark, files):
    return spark.createDataFrame([("o/r", SHA, p, f"{i:040d}", None if c is None else len(c), c, "clash", "clash") for i, (p, c) in enumerate(files)], SCHEMA)


def found(report):
    return sorted((r.path, r.start_line, r.score, tuple(r.matched_kinds)) for r in report.matches.collect())


def spec(*must, **more):
    return SearchSpec(tuple(Predicate.parse(m) if isinstance(m, str) else m for m in must), **more)


FILES = [
    ("a.py", "def foo(x):\n    return foo_bar(foo)\n# foo again\n"),
    ("b.rs", "pub fn foo<T>(x: T) {}\nlet y = foo<T>(1);\nuse std::foo;"),
    ("c.go", "func (r *R) foo() {}\nimport \"foo\"\ntype foo struct {"),
    ("d.js", "// foo in a comment\nconst foo = 'foo';\nfoo();\n"),
    ("e.txt", "foo\n"),
    ("f.py", ""),
    ("g.py", None),
    ("h.py", "héfoo foo\r\nfoo = 1\r\n\n"),
]


def test_predicates_by_language(spark):
    b = blobs(spark, FILES)
    lines = lambda *m: [x[:2] for x in found(search(b, spec(*m)))]
    assert lines("identifier:foo") == [("a.py", 1), ("a.py", 2), ("a.py", 3), ("b.rs", 1), ("b.rs", 2), ("b.rs", 3), ("c.go", 1), ("c.go", 2), ("c.go", 3), ("d.js", 2), ("d.js", 3), ("h.py", 1), ("h.py", 2)]
    assert lines("symbol_definition:foo") == [("a.py", 1), ("b.rs", 1), ("c.go", 1), ("c.go", 3), ("d.js", 2), ("h.py", 2)]
    assert lines("symbol_reference:foo") == [("a.py", 2), ("a.py", 3), ("b.rs", 2), ("b.rs", 3), ("c.go", 2), ("d.js", 3), ("h.py", 1)]
    assert lines("call:foo") == [("a.py", 1), ("b.rs", 1), ("b.rs", 2), ("c.go", 1), ("d.js", 3)]
    assert lines("import:foo") == [("b.rs", 3), ("c.go", 2)]
    assert lines("regex:again$") == [("a.py", 3)] and lines("regex:foo$") == []
    assert lines("exact_text:(foo)") == [("a.py", 2)]
    assert lines("token_sequence:return foo_bar") == [("a.py", 2)]
    assert lines("signature:x") == [("a.py", 1), ("b.rs", 1)]


def test_clauses(spark):
    b = blobs(spark, [("a.py", "x y\nx\ny z"), ("b.py", "x\ny"), ("c.py", "x y z\n")])
    x, y, z = (Predicate("identifier", c) for c in "xyz")
    assert found(search(b, spec(x, y))) == [("a.py", 1, 2.0, ("identifier",)), ("c.py", 1, 2.0, ("identifier",))]
    assert [m[:2] for m in found(search(b, spec(x, y, whole_file_must=True)))] == [("a.py", 1), ("a.py", 2), ("a.py", 3), ("b.py", 1), ("b.py", 2), ("c.py", 1)]
    assert [m[:2] for m in found(search(b, spec(x, must_not=(z,))))] == [("b.py", 1)]
    zt = Predicate("exact_text", "z")
    assert found(search(b, spec(x, should=(y, zt)))) == [("a.py", 1, 1.0, ("identifier",)), ("a.py", 2, 1.0, ("identifier",)), ("b.py", 1, 1.0, ("identifier",)), ("c.py", 1, 3.0, ("exact_text", "identifier"))]
    whole = found(search(b, spec(x, should=(y, zt), whole_file_must=True)))
    assert [m[2] for m in whole] == [3.0, 3.0, 2.0, 3.0]
    assert found(search(b, spec("path:c.py", should=(y,)))) == [("c.py", 1, 1.0, ("identifier",))]
    assert found(search(b, spec("path:c.py"))) == []


def test_scopes_paths_and_coverage(spark):
    b = blobs(spark, FILES)
    one = search(b, spec("exact_text:foo", scopes=(Scope("o/r", SHA), Scope("o/r", SHA)))).coverage.collect()[0]
    assert (one.files_eligible, one.files_indexed, one.files_excluded, one.status, one.exclusions) == (7, 6, 1, "partial", {"fetch_failed": 1})
    none = search(b, spec("exact_text:foo", scopes=(Scope("o/x", SHA),)))
    assert none.coverage.collect()[0].status == "complete_for_declared_universe" and found(none) == []
    assert [m[0] for m in found(search(b, spec("exact_text:foo:PY", "path:a")))] == ["a.py"] * 3
    big = spark.createDataFrame([("o/r", SHA, "big.py", "1" * 40, LARGE + 1, "x" * (LARGE + 1), "", "")], SCHEMA)
    assert search(big, spec("exact_text:x")).coverage.collect()[0].files_excluded == 1
    assert found(search(b.limit(0), spec("exact_text:foo"))) == []


def test_bad_specs():
    for bad in (lambda: spec(), lambda: spec("regex:("), lambda: spec("call:x:py", "call:y:go"), lambda: Predicate("call", " "), lambda: Scope("x", SHA), lambda: Scope("a/..", SHA), lambda: Scope("a/b", "1")):
        with pytest.raises(SpecError):
            bad()
    assert spec("call:x").digest() == spec("call:x").digest() != spec("call:y").digest()
    with pytest.raises(SpecError):
        translation(spec("regex:x"))
    assert translation(spec("call:x:py", "path:src"))[0] == "x path:src language:py"


def test_regexes_mean_the_same(spark):
    lines = ["foo bar", "héfoo", "a1_b2", "tab\there", "end\r", "ünï côdé", "", "x" * 50, "١٢٣", "foo-bar.baz"]
    for pattern in [r"\bfoo\b", r"^\w+$", r"\d+", r"[a-z]+-\w+", r"(?:foo|b2)$", r"(?<!h)foo", r"x{50}", r"\s", r"(?P<n>fo+) b", r".$"]:
        java = P.java_pattern(pattern)
        assert java is not None, pattern
        df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
        assert [r.i for r in df.where(F.col("t").rlike(java)).orderBy("i").collect()] == [i for i, t in enumerate(lines) if re.search(pattern, t)], pattern
    for pattern in [r"(?P<a>x)(?P=a)", r"(?i)x", r"x\Z", r"(x)\1"]:
        assert P.java_pattern(pattern) is None
    b = blobs(spark, [("a.py", "xx\nxy\nXX")])
    assert [m[:2] for m in found(search(b, spec(Predicate("regex", r"(x)\1"))))] == [("a.py", 1)]


def test_mask_keeps_lines():
    text = "a /* b\nc */ d 'e\\'f' // g\n`h\ni` \"j\n"
    assert P.masked(text).count("\n") == text.count("\n") and len(P.masked(text)) == len(text)
    assert "b" not in P.masked(text) and "d" in P.masked(text)


def test_index_gives_what_the_scan_gives(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gam", "de", "épsilon"]
    b = blobs(spark, [(f"{i}.{rng.choice(['py', 'js', 'go'])}", "\n".join(" ".join(rng.choices(words, k=4)) for _ in range(5))) for i in range(40)] + [("n.py", None), ("e.py", "ab")]).repartition(3)
    grams = T.index(b)
    for s in (spec("exact_text:beta gam"), spec("regex:al+pha \\w+ épsilon"), spec("exact_text:de"), spec("identifier:gam")):
        assert found(T.indexed_search(b, grams, s)) == found(search(b, s))
    assert T.literal_runs(r"abc(def)+gh?ijk") == ["abcdef", "ijk"] and T.literal_runs("(?i)abc") == [] and T.literal_runs("abc|def") == []


def test_order_ranks_and_dedup(spark):
    ids = [("o/r", SHA, f"{i % 7}.py", "b", i, i) for i in range(30)]
    m = spark.createDataFrame([(*x, float(i % 3), ["call"]) for i, x in enumerate(ids)], "slug string, commit_sha string, path string, blob_sha string, start_line int, end_line int, score double, matched_kinds array<string>")
    ranked = R.ranked_matches(m.repartition(5)).orderBy("rank").collect()
    want = sorted(((-float(i % 3), *x) for i, x in enumerate(ids)))
    assert [(-r.score, r.slug, r.commit_sha, r.path, r.blob_sha, r.start_line, r.end_line) for r in ranked] == want
    assert [r.rank for r in ranked] == list(range(1, 31)) and ranked[0].normalized_score == 1.0 and ranked[0].rank_score == 30
    twice = m.unionByName(m.withColumn("score", F.lit(9.0)).limit(3))
    assert R.dedup_matches(twice).count() == 30 and R.dedup_matches(twice).where("score = 9").count() == 3
    assert R.merged_matches(twice).count() == 30
    assert {r.normalized_score for r in R.normalized(m.where("score = 1")).collect()} == {1.0}


def test_metrics(spark):
    run = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3), ("u", "a", 1), ("v", "z", 1)], "task string, item string, rank int")
    judged = spark.createDataFrame([("t", "b", 1, True), ("t", "c", 2, True), ("u", "a", 1, False), ("v", "q", 2, False)], "task string, item string, grade int, complete boolean")
    out = {r.task: r for r in R.retrieval_metrics(run, judged).collect()}
    assert set(out) == {"t", "v"}
    assert round(out["t"].ndcg, 6) == round((1 / 1.5849625 + 1) / (2 + 1 / 1.5849625), 6)
    assert out["t"].rr == 1 / 3 and out["t"].success_1 == 0 and out["t"].recall == 1 and out["t"].precision_10 == 0.2 and round(out["t"].ap, 6) == round((1 / 2 + 2 / 3) / 2, 6)
    assert out["v"].rr == 0 and out["v"].ap is None


def test_u_test(spark):
    assert R.u_test(3, 3, 2 * (1 + 2 + 3), 0)[0] == 0 and R.u_test(0, 3, 0, 0)[2] == 1.0
    data = [("e", "a", float(v)) for v in (1, 2, 3, 4, 4)] + [("e", "b", float(v)) for v in (4, 5, 6, 7, 8)] + [("e", "b", None)]
    [r] = R.mann_whitney(spark.createDataFrame(data, "k string, g string, v double"), ["k"], "g", "a", "b", "v").collect()
    assert (r.n_first, r.n_second, r.u) == (5, 5, 1.0) and 0.01 < r.p_value < 0.03


def test_blob_sha_tree_and_lines(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "hello.txt").write_bytes(b"hello\n")
    (tmp_path / "d" / "x.py").write_bytes(b"a\r\nb\n\n")
    (tmp_path / "d" / "index.json").write_bytes(b"{}")
    t = scan_tree(spark, str(tmp_path), "o/r", SHA)
    assert sorted((r.path, r.blob_sha[:6]) for r in t.collect())[1] == ("hello.txt", "ce0136") and t.count() == 2
    one = tree_digests(t.withColumn("_d", F.sha2("content", 256)), ["slug"], "path", "blob_sha", "size").collect()[0]
    assert one.files == 2 and one.h1.startswith("h1:") and len(one.tree_sha) == 64
    text = t.withColumn("content", F.col("content").cast("string"))
    assert sorted((r.path, r.line_no, r.line) for r in line_rows(text).collect())[:3] == [("d/x.py", 1, "a\r"), ("d/x.py", 2, "b"), ("d/x.py", 3, "")]
    assert git_blob_sha is not None
