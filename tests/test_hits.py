import __spark_entry__ as E


def test_hits_come_from_all_snapshots(spark, tmp_path):
    data = [(1, "o/r", "a.py", "f()", "one"), (2, "o/r", "a.py", "f()", "two"), (6, "o/s", "b.py", None, "three"), (6, "o/s", "b.py", None, "three")]
    spark.createDataFrame(data, "snapshot_no int, slug string, path string, signature string, docstring string").write.parquet(f"{tmp_path}/symbol_snapshots.parquet")
    [counts] = E.queries()["hit_dedup_counts"](spark, str(tmp_path)).collect()
    assert (counts.hits, counts.pin_disagreements, counts.collapsed, counts.survivors) == (3, 1, 0, 2)
    assert sorted(r.path for r in E.queries()["hit_dedup"](spark, str(tmp_path)).collect()) == ["a.py", "b.py"]
