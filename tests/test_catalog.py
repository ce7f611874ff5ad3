"""Catalog, gates, graders, reports, producers and connectors on small fixtures."""

import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pinloom.functions import evidence as E
from pinloom.operators import gates as A
from pinloom.operators import graders as H
from pinloom.operators import graph as G
from pinloom.operators import predicates as P
from pinloom.operators import reports as Q
from pinloom.operators import trigram as T
from pinloom.operators.symbols import python_facts
from pinloom.operators.producers import Found, Registry, produced, scan
from pinloom.plans.search import run_benchmark, search, search_lines
from pinloom.plans.spec import Predicate, SearchSpec, refused
from pinloom.sources import catalog as K
from pinloom.sources.blobs import line_rows
from pinloom.sources.connectors import RecordedSearch, TreeSource, blob_sha
from pinloom.sources.manifests import edges_of

SHA = "a" * 40


def test_source_specs():
    for raw, want in [
        ("npm:left-pad@1.0", ("npm", "left-pad", "1.0", None, None, None)), ("@a/b@2", ("npm", "@a/b", "2", None, None, None)), ("cargo:x", ("crates", "x", None, None, None, None)), ("flask", ("npm", "flask", None, None, None, None)),
        ("o/r#main", (None, "o/r", None, "github.com", "main", "branch")), ("github:o/r@v1", (None, "o/r", None, "github.com", "v1", "tag")), (f"o/r@{SHA}", (None, "o/r", None, "github.com", SHA, "sha")), ("gitlab.com/a/b/c@t", (None, "a/b/c", None, "gitlab.com", "t", "tag")),
        ("https://gitlab.com/a/b/c/-/tree/main", (None, "a/b/c", None, "gitlab.com", "main", "branch")), ("https://bitbucket.org/o/r/src/dev/x", (None, "o/r", None, "bitbucket.org", "dev", "branch")), ("https://github.com/o/r.git", (None, "o/r", None, "github.com", None, None)),
    ]:
        s = K.parse_source(raw)
        assert (s.ecosystem, s.name, s.version, s.host, s.ref, s.ref_kind) == want, raw
    for raw in ("", " x", "http://github.com/o/r", "https://x.invalid/o/r", "zzz:x", "npm:", "go:x", "o/r#a@b", "https://github.com/o", "https://u:p@github.com/o/r", "o/r/s", "a b", "https://github.com/o/r?x=1"):
        with pytest.raises(K.SourceSpecError):
            K.parse_source(raw)


ENTRY = "host string, owner string, repo string, commit_sha string"


def test_catalog(spark):
    base = spark.createDataFrame([("h", "o", "r", "1", "old"), ("h", "o", "s", "1", "keep"), (None, "o", "t", "1", "null")], ENTRY + ", note string")
    new = spark.createDataFrame([("h", "o", "r", "1", "new"), ("h", "o", "r", "1", "newer"), ("h", "o", "u", "2", None)], ENTRY + ", note string")
    assert rows(K.upsert(base, new).select("repo", "note")) == sorted([("r", "newer"), ("s", "keep"), ("t", "null"), ("u", None)], key=repr)
    assert rows(K.remove(base, new).select("repo")) == [("s",), ("t",)]
    assert rows(K.scan_catalog(base, new.drop("note").distinct()).select("repo", "state")) == [("r", "found"), ("s", "missing_manifest"), ("t", "missing_manifest")]
    assert K.upsert(base.limit(0), new.limit(0)).count() == 0
    m = spark.createDataFrame([(SHA, "o", "..", None, "odd", None, "zz", None)], "commit_sha string, owner string, repo string, fetched_at timestamp, parity string, verified string, checksum string, tree_hash string")
    assert m.select(K.manifest_problems()).collect()[0][0] == ["checksum", "fetched_at", "parity", "repo", "tree_hash", "verified"]
    bad = spark.createDataFrame([("x", SHA, "z"), (None, "y", "z"), (SHA, None, None)], "a string, b string, c string")
    assert [r[0] for r in bad.select(K.pin(F.col("a"), F.col("b"), F.col("c"))).collect()] == [SHA, "z", SHA]


def test_gates(spark):
    c = A.Capability("go", "1.22", required_behaviors=(("b", "1", "d", "k"),), allowed_licenses=("MIT",), prohibited_dependencies=("x",))
    gates = A.expanded_gates(spark, c)
    assert [r.gate_id for r in gates.collect()] == sorted(r.gate_id for r in gates.collect()) and "performance.none" in {r.gate_id for r in gates.collect()}
    every = [("extraction", None), ("contract:valid", None), ("language:go", None), ("runtime:1.22", None), ("behavior-proof:b@1:d", "k"), ("license:MIT", None), ("dependency-closure:complete", None)]
    evidence = [("ok", k, s) for k, s in every] + [("dep", k, s) for k, s in every] + [("dep", "dependency:x", None)] + [("other", k, "z" if s else None) for k, s in every] + [("both", k, s) for k, s in every] + [("both", "behavior-absence:b@1:d", "k"), ("both", None, None)]
    candidates = spark.createDataFrame([("ok",), ("dep",), ("other",), ("both",), ("bare",), ("ok",)], "candidate string")
    results = A.evaluate_gates(candidates, spark.createDataFrame(evidence, "candidate string, kind string, collector string"), gates, c)
    verdicts = A.verdicts(results)
    assert rows(verdicts) == sorted([("ok", "pass", True), ("dep", "reject", True), ("other", "indeterminate", False), ("both", "indeterminate", False), ("bare", "indeterminate", False)], key=repr)
    assert rows(results.where("candidate = 'both' AND status = 'error'").select("gate_id")) == [("required_behavior.b@1",)]
    assert rows(A.survivors(candidates, verdicts)) == [("ok", "duplicate")]
    assert A.evaluate_gates(candidates.limit(0), spark.createDataFrame([], "candidate string, kind string, collector string"), gates, c).count() == 0


def test_graders(spark):
    tasks = spark.createDataFrame([(1, False), (2, True), (3, False)], "task int, unranked boolean")
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1), (2, "a", 1)], "task int, item string, rank int")
    exact = spark.createDataFrame([(1, "b"), (2, "a")], "task int, item string")
    hits = {(r.task, r.metric): (r.numerator, r.denominator, r.reason) for r in H.top_hits(ranking, exact, tasks).collect()}
    assert hits[1, "candidate_top1"] == (0, 1, None) and hits[1, "candidate_top3"] == (1, 1, None) and hits[2, "candidate_top1"] == (0, 0, "unranked_no_comparison_evidence") and hits[3, "candidate_top10"][2] == "no_gold"
    found = H.aggregated(H.recall("r", exact, ranking, tasks).unionByName(H.unjustified_rate("u", ranking, exact, tasks)))
    assert {r.metric: (r.numerator, r.denominator, r.excluded, r.exclusions, r.score_bps) for r in found.collect()} == {"r": (2, 2, 1, "no_gold=1", 10000), "u": (2, 4, 0, "", 5000)}
    span = "task int, s string, start_line int, end_line int"
    gold, members = spark.createDataFrame([(1, "f", 10, 19), (2, "g", 1, 4)], span), spark.createDataFrame([(1, "f", 15, 24), (1, "f", 30, 40)], span)
    assert rows(H.seed_overlap(gold, members, ["s"], False).select("task", "numerator", "denominator")) == [(1, 5, 15), (2, 0, 4)]
    assert rows(H.seed_overlap(gold, members, ["s"], True).select("task", "numerator")) == [(1, 0), (2, 0)]


def test_budgeted_closure(spark):
    edges = spark.createDataFrame([("a", "b", "donor"), ("b", "c", "donor"), ("c", "a", "donor"), ("b", "x", "stdlib"), ("c", "y", "external"), (None, "z", "donor")], "src string, dst string, dst_origin string")
    rules, pure = spark.createDataFrame([("c", "include")], "node string, disposition string"), spark.createDataFrame([("x",)], "node string")
    found = G.classified_edges(edges, rules, pure)
    assert rows(found.where("src = 'b'").select("dst", "disposition", "decided_by")) == [("c", "include", "rule"), ("x", "external", "allowlist")]
    nodes, seeds, none = spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([], "node string")
    members, totals = G.budgeted_closure(found, nodes, seeds, none, 10, 10, 100)
    assert rows(members.select("node", "depth", "state")) == [("a", 0, "member"), ("b", 1, "member"), ("c", 2, "member")] and totals.collect()[0].status == "reject"
    good = found.where("dst <> 'y'")
    assert G.budgeted_closure(good, nodes, seeds, none, 10, 10, 100)[1].collect()[0].status == "complete"
    assert G.budgeted_closure(good, nodes, seeds, none, 1, 10, 100)[1].collect()[0].status == "partial" and G.budgeted_closure(good, nodes, seeds, nodes, 10, 10, 100)[1].collect()[0].status == "reject"


def test_reports(spark):
    schema = "slug string, commit_sha string, path string, blob_sha string, start_line int, end_line int, score double, matched_kinds array<string>"
    good = [("s", "c", "p", "b", i, i, 1.0, ["x"]) for i in range(1, 4)]
    cover = spark.createDataFrame([(3, 3, 0, "complete_for_declared_universe")], "files_eligible long, files_indexed long, files_excluded long, status string")
    assert Q.report_problems(spark.createDataFrame(good, schema), cover).count() == 0
    bad = [good[0], good[0], ("s", "c", "p", "b", 0, 0, float("nan"), []), (None, "c", "p", "b", 5, 4, None, None)]
    wrong = spark.createDataFrame([(3, 1, 1, "complete_for_declared_universe")], "files_eligible long, files_indexed long, files_excluded long, status string")
    assert rows(Q.report_problems(spark.createDataFrame(bad, schema), wrong)) == [("bad_lines", 2), ("bad_score", 2), ("coverage_status", 1), ("coverage_sum", 1), ("duplicate_identity", 1), ("no_kinds", 2)]
    files = spark.createDataFrame([("t", f"p{i}", 10 * i) for i in range(30)] + [("u", None, 5)], "tree string, path string, size long")
    took = Q.deterministic_sample(files, ["tree"], "seed", 4, 300).where("tree = 't'").orderBy("position").collect()
    assert [r.position for r in took] == [1, 2, 3, 4] and sum(r.size for r in took) <= 300 and Q.deterministic_sample(files.limit(0), ["tree"], "s", 1, 1).count() == 0


def test_snapshots_are_imported_whole_or_not_at_all(spark, tmp_path):
    df = spark.createDataFrame([("o/r", SHA, "a", b"1"), ("o/r", SHA, "b", None), ("o/s", SHA, "a", b""), ("o/r", SHA, "a", b"1")], "slug string, commit_sha string, path string, content binary")
    folder = f"{tmp_path}/snap"
    assert rows(Q.export_snapshot(df, folder).select("slug", "files")) == [("o/r", 2), ("o/s", 1)]
    assert Q.import_snapshot(spark, folder).count() == 3
    df.withColumn("content", F.lit(b"2")).write.mode("overwrite").parquet(f"{folder}/files")
    with pytest.raises(ValueError):
        Q.import_snapshot(spark, folder)


def test_stored_index(spark, tmp_path):
    blob = "slug string, commit_sha string, path string, blob_sha string, size long, content string"
    df = spark.createDataFrame([("o/r", SHA, f"{i}.py", f"b{i}", 20, f"row {i} has needle{i % 3}\n") for i in range(9)] + [("o/r", SHA, "x.js", "bx", 3, "// needle1"), ("o/r", SHA, "n.py", "bn", 0, None), ("o/r", SHA, "e.py", "be", 0, "")], blob)
    folder = f"{tmp_path}/index"
    assert T.write_index(df, folder)["documents"] == 11
    index = T.open_index(spark, folder, df)
    spec = SearchSpec((Predicate("exact_text", "needle1"),))
    assert rows(T.indexed_search(df, index, spec).matches.select("path")) == rows(search(df, spec).matches.select("path")) == [("1.py",), ("4.py",), ("7.py",)]
    with pytest.raises(ValueError):
        T.open_index(spark, folder, df.where("path <> '1.py'"))


JS = "import { Base } from './base.js';\n// call(fake)\nexport class Leaf extends Base {\n  static async run(a) {\n    helper(\"call(x)\");\n    throw new Oops(a);\n  }\n}\nfunction helper(q) { return unknown(q); }\nclass Oops {}\n"
GO = "package a\n\nimport (\n\tm \"x/maths\"\n)\n\ntype Base struct{}\n\ntype T struct {\n\tBase\n}\n\nfunc (t *T) Run(a int) int {\n\t_ = T{}\n\treturn m.Do(a)\n}\n"
RS = "use crate::shape::{Walk, other as o};\npub struct Tree<'a> { x: &'a str }\nimpl<'a> Walk for Tree<'a> {\n    fn walk(&self) { o(1); let c = '\"'; }\n}\n"


def test_producers(spark):
    js, go, rs = scan("javascript", "m", JS), scan("go", "m", GO), scan("rust", "m", RS)
    assert [(k, q, n) for k, q, n, _ in js.symbols] == [("class", "Leaf", 3), ("method", "Leaf.run", 4), ("function", "helper", 9), ("class", "Oops", 10)]
    assert sorted(js.edges) == sorted([("imports", "m", "./base.js:Base", 1), ("inherits", "m.Leaf", "./base.js:Base", 3), ("calls", "m.Leaf.run", "m.helper", 5), ("raises", "m.Leaf.run", "m.Oops", 6), ("instantiates", "m.Leaf.run", "m.Oops", 6)]) and js.unresolved == [("calls", "m.helper", "unknown", 9)]
    assert sorted(go.edges) == sorted([("imports", "m", "x/maths", 4), ("inherits", "m.T", "m.Base", 10), ("instantiates", "m.T.Run", "m.T", 14), ("calls", "m.T.Run", "x/maths.Do", 15)]) and not go.unresolved
    assert sorted(rs.edges) == sorted([("imports", "m", "crate::shape::Walk", 1), ("imports", "m", "crate::shape::other", 1), ("inherits", "m.Tree", "crate::shape::Walk", 3), ("calls", "m.Tree.walk", "crate::shape::other", 4)])
    registry = Registry()
    registry.register("ruby", (".rb",), lambda module, text: Found(edges=[("calls", module, "puts", 1)]))
    for bad in (lambda: registry.register("ruby", (".rb",), print), lambda: registry.register("go", (".go",), print), lambda: registry.register("x", (), print)):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([("s", "a.rb", b"x"), ("s", "a.go", GO.encode()), ("s", None, b"x"), ("s", "b.go", None), ("s", "c.js", b""), ("s", "a.go", GO.encode()), ("s", "d.py", b"import os\n")], "slug string, path string, content binary")
    out = produced(df, registry)
    assert out.where("entry = 'edge'").groupBy("language").count().orderBy("language").collect() == [("go", 4), ("python", 1), ("ruby", 1)] and produced(df.limit(0)).count() == 0


def test_registered_language(spark):
    P.register_language("kotlin", (".kt",), (r"^\s*fun\s+N\b",), r"^\s*import\s")
    try:
        blob = "slug string, commit_sha string, path string, blob_sha string, size long, content string"
        df = spark.createDataFrame([("o/r", SHA, "a.kt", "b", 9, "fun go() {}\n// go()\nval x = go()")], blob)
        assert rows(search(df, SearchSpec((Predicate("symbol_definition", "go"),))).matches.select("start_line")) == [(1,)]
        assert rows(search(df, SearchSpec((Predicate("call", "go", "kotlin"),))).matches.select("start_line")) == [(1,), (3,)]
        with pytest.raises(ValueError):
            P.register_language("python", (".py",), ("N",), "x")
    finally:
        P.SUFFIXES.pop()
        P.MASKED.pop()
        del P.DEFINITIONS["kotlin"], P.IMPORTS["kotlin"]


def test_connectors(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "d" / "e").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"hello\n")
    (root / "d" / "e" / "b").write_bytes(b"")
    (root / "index.json").write_bytes(b"{}")
    os.symlink("a.txt", root / "l")
    spark.dataSource.register(TreeSource)
    df = spark.read.format("pinloom_tree").option("path", str(root)).option("slug", "o/r").option("commit", SHA).load()
    assert rows(df.select("path", "mode", "size", "blob_sha")) == sorted([("a.txt", "100644", 6, "ce013625030ba8dba906f756967f9e9ca394464a"), ("d/e/b", "100644", 0, blob_sha(b"")), ("l", "120000", 5, blob_sha(b"a.txt"))], key=repr)
    pages = tmp_path / "pages"
    pages.mkdir()
    item = lambda ref, html: {"repository": {"full_name": "o/r"}, "path": "p", "sha": "b", "url": f"https://x.invalid?ref={ref}", "html_url": f"https://x.invalid/o/r/blob/{html}/p"}
    (pages / "page1.json").write_text(json.dumps({"total_count": 2, "items": [item(SHA, SHA), item(SHA, "b" * 40), {}]}))
    (pages / "page2.json").write_text(json.dumps({"items": None}))
    spark.dataSource.register(RecordedSearch)
    assert rows(spark.read.format("pinloom_search").option("path", str(pages)).load().select("page", "slug", "commit_sha")) == [(1, "o/r", SHA)]


def test_evidence_columns(spark):
    df = spark.createDataFrame([("LICENSE-MIT", 429, None, "30"), ("x/apache.txt", 403, 0, "soon"), ("readme", 403, 5, None), (None, 503, None, "Wed, 21 Oct 2015 07:28:00 GMT")], "path string, status int, remaining int, after string")
    got = df.select(E.licence_of_name(F.col("path")), E.http_class(F.col("status"), F.col("remaining")), E.retry_after(F.col("after"), F.lit("2015-10-21 07:27:00").cast("timestamp"))).collect()
    assert [tuple(r) for r in got] == [("MIT", "rate_limited", 30), ("Apache-2.0", "rate_limited", None), (None, "denied", None), (None, "retry", 60)]
    line = spark.createDataFrame([("aé日x", 2)], "line string, c int")
    assert [tuple(r) for r in line.select(E.byte_column(F.col("line"), F.col("c")), E.character_column(F.col("line"), F.lit(3)), E.character_column(F.col("line"), F.lit(2))).collect()] == [(3, 2, None)]


def test_lock_files_of_pnpm_and_yarn():
    pnpm = "lockfileVersion: 5.4\nspecifiers:\n  a: 1\npackages:\n\n  /left-pad/1.3.0:\n    resolution: {integrity: sha512-ab+/=}\n    dev: true\n\n  /@s/b@2.0.1(react@18.0.0):\n    dev: false\n  weird:\nother:\n  /x/1.0.0:\n"
    assert edges_of("pnpm-lock.yaml", pnpm) == ("complete", [("npm", "left-pad", "1.3.0", "sha512-ab+/=", "left-pad@1.3.0"), ("npm", "@s/b", "2.0.1", None, "@s/b@2.0.1")], [("line:12", "unsupported")])
    yarn = '# yarn lockfile v1\n\n"@s/b@^1.0.0", "@s/b@^1.1.0":\n  version "1.2.3"\n  resolved "https://x.invalid"\n  integrity sha512-xy\n\nleft-pad@1.x:\n  version "1.3.0"\n\nbroken@1:\n  dependencies:\n    a "1"\n'
    assert edges_of("yarn.lock", yarn) == ("complete", [("npm", "@s/b", "1.2.3", "sha512-xy", "@s/b@1.2.3"), ("npm", "left-pad", "1.3.0", None, "left-pad@1.3.0")], [("line:11", "malformed")])
    assert edges_of("yarn.lock", "") == ("complete", [], []) and edges_of("pnpm-lock.yaml", "packages:\n") == ("complete", [], [])


def test_search_over_lines_is_the_search_over_blobs(spark):
    blob = "slug string, commit_sha string, path string, blob_sha string, size long, content string"
    df = spark.createDataFrame([("o/r", SHA, "a.py", "1", 1, "row x\nrow y\nz"), ("o/r", SHA, "b.go", "2", 1, "row x\n\nskip"), ("o/r", SHA, "c.js", "3", 1, "row"), ("o/r", SHA, "d.rs", "4", 1, ""), ("o/r", SHA, "e.txt", "5", 1, "row")], blob)
    row, skip, x = Predicate("exact_text", "row"), Predicate("exact_text", "skip"), Predicate("identifier", "x")
    for spec in (SearchSpec((row,)), SearchSpec((row,), must_not=(skip,)), SearchSpec((row,), should=(x,)), SearchSpec((row,), must_not=(x,), must_not_lines=True)):
        want = rows(search(df.where("path <> 'c.js'"), spec).matches)
        assert rows(search_lines(line_rows(df), spec)) == want and want
    with pytest.raises(ValueError):
        search_lines(line_rows(df), SearchSpec((row,), whole_file_must=True))
    with pytest.raises(ValueError):
        run_benchmark(df, [("t", SearchSpec((row,)), "0" * 64)])
    assert refused(SearchSpec((row, x)), {("must", "exact_text")}) == [("must", "identifier")]


def test_tree_walk(spark):
    entry = "tree string, name string, kind string, sha string, mode string"
    rows_ = [("r", "a", "blob", "1", "100644"), ("r", "d", "tree", "t", "040000"), ("t", "b", "blob", "2", "100755"), ("t", "e", "tree", "u", "040000"), ("u", "c", "blob", "3", "120000"), ("x", "y", "blob", "4", "100644")]
    root = spark.createDataFrame([("r",)], "tree string")
    df = spark.createDataFrame([*rows_, rows_[0]], entry)
    assert rows(G.walk_tree(df, root)) == [("a", "1", "100644"), ("d/b", "2", "100755"), ("d/e/c", "3", "120000")]
    for more, depth in (((("r", "a", "blob", "9", "100644"),), 64), ((), 2), ((("u", "z", "tree", "r", "040000"),), 10)):
        with pytest.raises(ValueError):
            G.walk_tree(spark.createDataFrame([*rows_, *more], entry), root, depth)
    assert G.walk_tree(df.limit(0), root).count() == 0


def test_reads_are_edges():
    facts = python_facts("m", b"LIMIT = 3\ndef helper(x):\n    return x + LIMIT\ndef run():\n    f = helper\n    return helper(LIMIT)\n")
    assert [(v, d) for k, v, _, _, _, d in facts if k == "edge:reads"] == [("m.LIMIT", "m.helper"), ("m.helper", "m.run"), ("m.LIMIT", "m.run")]
