"""The registered searches over a small table of documents, by brute force."""

import re

import pytest

import __spark_entry__ as E
from pinloom.operators import predicates as P

SCHEMA = "doc_id long, text string, lang string, source string"
JS = "import x from 'import';\nconst acc = len(a, b=1); // adapter\nfunction len(acc, n=2) { return adapter + ledger; }\n/* adapter\nledger */ 'optional adapter';\nreturns  the optional adapter, cache\nIn release 1.2 the ledger quickly moved adapter"
DOCUMENTS = [(11, "an adapter\nledger and optional adapter\nno", "en", "o/r"), (12, JS, "javascript", "o/r"), (13, "let adapter = ledger;", "javascript", "o/r"), (14, "adapter", "es", "o/r")]
WHOLE = r"^(?=[\s\S]*adapter)(?=[\s\S]*\bledger\b)"
#: For each query the pattern that a masked line holds, and one that the masked file holds.
QUERIES = {
    "scoped_exact_text": ("adapter", ""), "scoped_identifier": (r"\bledger\b", ""), "scoped_regex": (r"^In release \d+\.\d+ the (\w+) [a-z]+ moved", ""), "token_sequence": (r"\breturns\s+the\s+optional\b", ""),
    "symbol_definition": (r"^\s*const acc\b", ""), "symbol_reference": (r"^(?!\s*const acc).*\bacc\b", ""), "call_predicate": (r"\blen\s*\(", ""), "signature_predicate": (r"\w+\(\w+, \w+=\d+\)", ""),
    "must_and_line": (r"(?=.*adapter).*\bledger\b", ""), "must_and_wholefile": (r"adapter|\bledger\b", WHOLE), "must_not_doc": ("adapter", r"^(?![\s\S]*cache)"), "should_boost_line": ("adapter", ""), "should_boost_file": ("adapter", ""),
    "ranked_matches": ("adapter", ""), "match_dedup": ("adapter", ""), "must_not_line": (r"^(?!.*cache).*adapter", ""), "index_equals_scan": ("optional adapter", ""), "merged_matches": ("adapter", ""), "streaming_search": ("adapter", ""),
}


def folder(spark, tmp_path, documents):
    spark.createDataFrame(documents, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("small"), DOCUMENTS)


@pytest.mark.parametrize("name", QUERIES)
def test_searches_see_javascript(spark, small, name):
    line, whole = QUERIES[name]
    texts = {f"javascript/{i}.js": P.masked(t) for i, t, lang, _ in DOCUMENTS if lang == "javascript"}
    want = sorted((p, n) for p, t in texts.items() if re.search(whole, t) for n, x in enumerate(t.split("\n"), 1) if re.search(line, x))
    assert want
    assert sorted((r.path, r.start_line) for r in E.queries()[name](spark, small).where("path LIKE '%.js'").collect()) == want


def test_permalinks_see_javascript(spark, small):
    links = [r.permalink for r in E.queries()["permalinks"](spark, small).collect()]
    assert sorted(x.split("/blob/")[1].split("/", 1)[1] for x in links) == ["en/11.py#L2", "javascript/12.js#L6"]


def test_source_of_every_language_is_searched(spark, tmp_path):
    claims = ["en", "EN", "fr", "de", "python", "Python", "go", "rust", "javascript", "JavaScript", "es", "ja", "und", None]
    d = folder(spark, tmp_path, [(i, "import x\nn = len(x)", lang, "o/r") for i, lang in enumerate(claims)])
    want = ["EN/1.py", "JavaScript/9.js", "Python/5.py", "de/3.go", "en/0.py", "fr/2.rs", "go/6.go", "javascript/8.js", "python/4.py", "rust/7.rs"]
    assert sorted(r.path for r in E.queries()["call_predicate"](spark, d).collect()) == want
    assert len({r.path for r in E.queries()["blob_lines"](spark, d).collect()}) == len(claims)
