import random

import numpy as np
from conftest import rows

from pinloom.llm import leakage as L
from pinloom.llm import packing as K
from pinloom.llm import spans as S
from pinloom.llm import splitting as B
from pinloom.llm.fm_index import FMIndex


def brute_shared(files, run):
    windows = {}
    for i, data in files:
        ls = S.lines_of(data)
        for k in range(len(ls) - run + 1):
            windows.setdefault(tuple(ls[k : k + run]), set()).add(i)
    out = set()
    for i, data in files:
        ls = S.lines_of(data)
        shared = sorted({k + j for k in range(len(ls) - run + 1) if len(windows[tuple(ls[k : k + run])]) > 1 for j in range(run)})
        while shared:
            end = 1
            while end < len(shared) and shared[end] == shared[0] + end:
                end += 1
            out.add((i, shared[0] + 1, shared[end - 1] + 1))
            shared = shared[end:]
    return sorted(out)


def test_shared_spans_agree_with_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    base = [b"".join(b"line %d\n" % rng.randrange(40) for _ in range(60)) for _ in range(3)]
    files = []
    for i in range(25):
        a = rng.randrange(30)
        part = b"\n".join(rng.choice(base).split(b"\n")[a : a + rng.randrange(5, 30)])
        files.append((i, b"own %d\n" % i + part + rng.choice([b"", b"\n", b"\r\nx\n"]) + b"tail %d" % i))
    files += [(100, b"}\n" * 40), (101, b"}\n" * 30), (102, b""), (103, None), (104, files[0][1]), (105, b"a\r\n" * 14), (106, b"a\n" * 14)]
    df = spark.createDataFrame([(i, c, "x") for i, c in files + files[:5]] + [(None, files[0][1], "x")], "file_id long, content binary, _id string")
    got = S.shared_spans(df).select("file_id", "start_line", "end_line")
    assert rows(got) == sorted(brute_shared([f for f in files if f[1] is not None], 12), key=repr)
    assert rows(S.shared_spans(df.limit(0))) == []
    # a minimizer that many passages share is compared phrase by phrase
    monkeypatch.setattr(S, "HOT_PASSAGES", 1)
    assert rows(S.shared_spans(df).select("file_id", "start_line", "end_line")) == rows(got)


def test_packing_fills_and_assigns_everything():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(0, 101, 3000), np.full(700, 40), np.array([0, 0]), np.array([], dtype=int), np.concatenate([np.full(500, 60), np.full(500, 25), np.full(480, 15)]), rng.integers(60, 101, 200)):
        containers, made = K.pack_lengths(lengths, 100)
        fill = np.bincount(containers, weights=lengths, minlength=made) if len(lengths) else np.zeros(0)
        assert len(containers) == len(lengths) and (fill <= 100).all() and (not len(lengths) or containers.max() < made)
    containers, made = K.pack_lengths(rng.integers(1, 60, 20_000), 100)
    assert made <= 1.002 * 20_000 * 30 / 100 * 1.02
    assert K.pack_lengths(np.array([50, 30, 20, 100, 70, 20, 10]), 100)[1] == 3


def test_packed_texts(spark):
    texts = [(1, "word " * 9000), (2, ""), (3, None), (4, "a b c"), (5, "a b c"), (None, "x")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, _n int")
    out = K.pack_texts(df, tokenizer="byte_bpe_50k").collect()
    assert sorted({r.doc_id for r in out}, key=str) == sorted({i for i, _ in texts}, key=str)
    long = sorted((r.piece_no, r.start_token, r.n_tokens) for r in out if r.doc_id == 1)
    assert long[0] == (0, 0, 8192) and long[1][1] == 8192 and sum(x[2] for x in long) > 9000
    assert all(r.n_tokens == 0 for r in out if r.doc_id in (2, 3))
    assert K.containers(K.pack_texts(df, tokenizer="byt5")).where("filled > 8192 OR unused < 0").count() == 0
    assert K.pack_texts(df.limit(0)).count() == 0


def test_pieces_cover_the_text(spark):
    rng = random.Random(4)
    texts = ["x" * 8192, "x" * 8193, "é" * 9000, "One sentence here. " * 2000, "\n\n".join("p" * rng.randrange(1, 3000) for _ in range(40)), "", "日本語。" * 5000, " " * 20000]
    for text in texts:
        data = text.encode()
        pieces = B.split(data, 8192, 128)
        end = 0
        for k, (a, b) in enumerate(pieces):
            assert b - a <= 8192 and b > end or not data
            assert a == 0 if not k else end - 131 <= a <= end - 128
            data[a:b].decode()
            end = b
        assert end == len(data) and (len(pieces) > 1) == (len(data) > 8192)
    paragraphs = ("word " * 300 + "\n\n") * 12
    assert all(paragraphs.encode()[b - 2 : b] == b"\n\n" for _, b in B.split(paragraphs.encode()))
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None), (1, texts[1])], "doc_id long, text string")
    assert rows(B.split_texts(df, with_text=False).where("piece_no = 0 AND n_pieces > 1").select("doc_id")) == [(1,), (2,), (3,), (4,), (6,), (7,)]
    assert B.split_texts(df.limit(0)).count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 5, 3000)
    text[500:900] = text[1500:1900]
    index = FMIndex(text.astype(np.int32), 5)
    s = text.tolist()
    patterns = [[1], [4, 4], [1, 2, 3], [3, 3, 3, 3], [x for x in s[520:560] if x][:9], [2, 2, 2, 2, 2, 2, 2, 2]]
    width = max(map(len, patterns))
    table = np.array([[0] * (width - len(p)) + p for p in patterns])
    low, high = index.search(table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(s) - len(p) + 1) if s[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_leaks(docs, items):
    out = set()
    for i, t in items:
        w = L.words(t or "")
        for d, text in docs:
            v = L.words(text or "")
            n = min(13, len(w))
            if n and any(w[a : a + n] == v[b : b + n] for a in range(len(w) - n + 1) for b in range(len(v) - n + 1)):
                out.add((d, i))
    return sorted(out)


def test_leaks_agree_with_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["alpha", "Beta", "gamma_delta", "straße", "x1", "İ", "７", "né"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(30)] + [(50, None), (51, "?!")]
    docs = []
    for d in range(60):
        words = rng.choices([*vocabulary, "other"], k=30)
        if d % 3 == 0:
            leaked = (items[rng.randrange(30)][1]).upper().split(" ")
            words[5:5] = leaked
        docs.append((d, rng.choice([" ", "-", "\n"]).join(words)))
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    assert rows(L.leaked_items(df, it)) == sorted(brute_leaks(docs, items), key=repr)
    assert rows(L.leaked_items(df, it.limit(0))) == [] and rows(L.leaked_items(df.limit(0), it)) == []
    one = spark.createDataFrame([(1, "say ALPHA-beta, alpha beta!")], "doc_id long, text string")
    assert rows(L.leaked_spans(one, spark.createDataFrame([(7, "alpha beta")], "item_id long, text string"))) == [(1, 16, 26, [7]), (1, 4, 14, [7])]


def brute_spans(docs, items):
    """Each document's characters that phrases cover, as joined spans."""
    out = []
    for d, text in docs:
        found = [(m.group().lower(), m.start(), m.end()) for m in L.WORD.finditer(text or "")]
        held = []
        for i, t in items:
            w = L.words(t or "")
            n = min(13, len(w))
            for a in range(len(w) - n + 1) if n else ():
                held += [(found[b][1], found[b + n - 1][2], i) for b in range(len(found) - n + 1) if [x for x, _, _ in found[b : b + n]] == w[a : a + n]]
        joined = []
        for a, b, i in sorted(held):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(joined[-1][1], b), joined[-1][2] | {i})
            else:
                joined.append((a, b, {i}))
        out += [(d, b, sorted(i), a) for a, b, i in joined]
    return sorted(out)


def test_leaked_spans_in_one_block_and_in_several(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "gamma_delta", "straße", "x1", "né"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 3, 13, 20])))) for i in range(12)] + [(50, None)]
    docs = [(d, " ".join([*rng.choices([*vocabulary, "other"], k=40), items[d % 12][1], *rng.choices(vocabulary, k=5)])) for d in range(20)] + [(90, None), (91, "")]
    df = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = brute_spans(docs, items)
    for size in (L.BLOCK_BYTES, 200):
        monkeypatch.setattr(L, "BLOCK_BYTES", size)
        got = sorted((r.doc_id, r.end_char, r["items"], r.start_char) for r in L.leaked_spans(df, it).collect())
        assert got == want, size
        assert rows(L.leaked_items(df, it)) == sorted(brute_leaks(docs, items), key=repr)
