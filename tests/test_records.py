import datetime as dt
import json
import random

from conftest import rows

from pinloom.operators import nested as N
from pinloom.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, delivered_at timestamp, k1 string, k2 string, v string, _k1 string, change_kind string"


def brute(data, first, last):
    latest = {}
    for s, at, k1, k2, v, *_ in data:
        if s is not None and first <= s <= last:
            key = (s, k1, k2)
            if key not in latest or latest[key][0] <= at:
                latest[key] = (at, v)
    out = []
    for s in range(first + 1, last + 1):
        keys = {k[1:] for k in latest if k[0] in (s - 1, s)}
        for k in keys:
            a, b = latest.get((s - 1, *k)), latest.get((s, *k))
            if a is None:
                out.append((s, *k, "added"))
            elif b is None:
                out.append((s, *k, "removed"))
            elif a[1] != b[1]:
                out.append((s, *k, "changed"))
    return sorted(out, key=repr)


def test_changes_agree_with_brute_force(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(600):
        s = rng.choice([1, 2, 3, 4, None])
        # one key is a third of all rows; keys and values are null at times
        k = ("hot", "hot") if rng.random() < 0.33 else (rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None, ""]))
        data.append((s, start + dt.timedelta(seconds=i), *k, rng.choice(["1", "2", None]), "clash", "clash"))
    data += data[:50]
    got = rows(snapshot_changes(spark.createDataFrame(data, SCHEMA), ["k1", "k2"], ["v"], 1, 4))
    assert got == brute(data, 1, 4)


def test_changes_with_values_and_empty(spark):
    at = dt.datetime(2024, 1, 1)
    data = [(1, at, "a", None, "1", "", ""), (2, at, "a", None, "2", "", ""), (2, at, "b", "q", None, "", "")]
    out = rows(snapshot_changes(spark.createDataFrame(data, SCHEMA), ["k1", "k2"], ["v"], 1, 2, with_values=True))
    assert [(r[1], r[3], r[4] and r[4].v, r[5] and r[5].v) for r in out] == [("a", "changed", "1", "2"), ("b", "added", None, None)]
    assert rows(snapshot_changes(spark.createDataFrame([], SCHEMA), ["k1"], ["v"], 1, 2)) == []


def test_null_key_differs_from_shifted_null(spark):
    at = dt.datetime(2024, 1, 1)
    data = [(1, at, None, "x", "1", "", ""), (2, at, "x", None, "1", "", "")]
    got = rows(snapshot_changes(spark.createDataFrame(data, SCHEMA), ["k1", "k2"], ["v"], 1, 2))
    assert got == [(2, "x", None, "added"), (2, None, "x", "removed")] or len(got) == 2


def records(spark, payloads):
    return spark.createDataFrame([(i, "task", p, "x") for i, p in enumerate(payloads)], "record_id long, record_kind string, payload string, _text string")


ALL = [N.SITES, N.BINDINGS, N.QRELS, N.JUDGMENTS]


def test_nested_rows_and_odd_shapes(spark):
    edge = {"provenance": {"site": {"end_line": 0}, "binding": {"commit_sha": [1]}}}
    payloads = [
        json.dumps({"golden": {"edges": [edge, None, 3, {"provenance": {"site": {"end_line": None}, "binding": {}}}]}}),
        json.dumps({"golden": {"edges": edge}}),  # an object is an array of one
        json.dumps(json.dumps({"tasks": {"gold": {"candidate_qrels": [{"grade": 0}, {"grade": None}, {"grade": "x"}]}}})),
        json.dumps({"tasks": [{}, {"judgments": [{"source": {"path": ""}}, {"source": None}, {"source": "s"}]}]}),
        '{"tasks": [{"judgments": [{"source": {"path": 1}}]}]} trailing',
        '{"tasks": [{"judgments": [{"source": {"path": 1}}]}]}]',
        '{"tasks": []},"a": 1',
        '{"tasks": [{"judgments": {"source": {"path": 1}}}], "tasks": [{"judgments": {"source": {"path": 1}}}]}',
        None,
        "",
        "null",
        "[1]",
        '"open',
        json.dumps({"tasks": [{"judgments": [{"source": {"path": "p" * 100_000}}]}]}),
    ]
    got = rows(N.entity_index(records(spark, payloads + payloads[:3]), ALL, "payload", "record_id"))
    want = [(0, "site", 0, 0), (0, "binding", 0, 0), (1, "site", 0, 0), (1, "binding", 0, 0), (2, "qrel", 0, 0), (2, "qrel", 0, 2), (3, "judgment", 1, 0), (7, "judgment", 0, 0), (13, "judgment", 0, 0)]
    want += [(14, "site", 0, 0), (14, "binding", 0, 0), (15, "site", 0, 0), (15, "binding", 0, 0), (16, "qrel", 0, 0), (16, "qrel", 0, 2)]
    assert got == sorted(want, key=repr)


def test_flat_tables_link_to_parents(spark):
    data = records(spark, [json.dumps({"tasks": [{"task_id": "t", "gold": {"candidate_qrels": [{"grade": 2, "identity": {"slug": "a/b", "end_line": "7"}}]}}]})])
    [row] = N.flat_table(data, N.QRELS, "payload", ["record_id"]).collect()
    assert (row.pos_0, row.pos_1, row.grade, row.slug, row.end_line) == (0, 0, "2", "a/b", 7)
    assert rows(N.flat_table(data, N.EDGES, "payload", ["record_id"])) == []
    assert rows(N.entity_index(data.limit(0), ALL, "payload", "record_id")) == []


def test_wraps_of_any_number_are_opened(spark):
    text = json.dumps({"tasks": [{"judgments": [{"source": {"path": "p"}}]}]})
    wrapped = [text]
    for _ in range(5):
        wrapped.append(json.dumps(wrapped[-1]))
    payloads = [*wrapped, *(f"{c}{wrapped[1]}{c}" for c in " \t\r\n"), json.dumps("\n\t" + wrapped[1]), wrapped[2] + "x", wrapped[2] + wrapped[2], json.dumps('"open'), '"\\ud800"', '"', '"a\nb"', None]
    assert rows(N.entity_index(records(spark, payloads), ALL, "payload", "record_id")) == sorted(((i, "judgment", 0, 0) for i in range(11)), key=repr)
    assert [r.record_id for r in N.flat_table(records(spark, wrapped), N.TASKS, "payload", ["record_id"]).orderBy("record_id").collect()] == list(range(6))
