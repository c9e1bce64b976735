"""Tables by key: replacement, writers at the same time, writers that fail."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factledger.operators import design
from factledger.sources import runs, store


def replies(spark, rows):
    return spark.createDataFrame(rows, runs.REPLY)


def kept(spark, path):
    return {r.key: (r.text, r.stop_reason, r.max_tokens) for r in runs.read_replies(spark, path).collect()}


def test_a_key_stands_once(spark, tmp_path):
    path = str(tmp_path / "s")
    assert kept(spark, path) == {}
    assert runs.write_replies(replies(spark, []), path) == 0
    first = [("a", "cut", "max_tokens", 10), ("b", "whole", "end_turn", 10), ("b", "longer limit", "end_turn", 20), (None, "x", "end_turn", 1), ("c", None, None, None)]
    assert runs.write_replies(replies(spark, first), path) == 1
    assert kept(spark, path) == {"a": ("cut", "max_tokens", 10), "b": ("longer limit", "end_turn", 20), "c": (None, None, None)}
    asked = spark.createDataFrame([("a", 20), ("b", 99)], "key string, max_tokens long")
    assert [r.key for r in design.cache_misses(asked, runs.read_replies(spark, path)).collect()] == ["a"]
    runs.write_replies(replies(spark, [("a", "now whole", "end_turn", 20), ("b", "cut", "length", 500)]), path)
    assert kept(spark, path)["a"] == ("now whole", "end_turn", 20) and kept(spark, path)["b"][0] == "longer limit"
    assert runs.read_replies(spark, path).count() == 3


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    runs.write_replies(replies(spark, [(f"k{i}", "t", "end_turn", 1) for i in range(500)]), path)
    before = store._current(store._Folder(spark, path))[1]["folders"]
    runs.write_replies(replies(spark, [("k7", "t", "end_turn", 9)]), path)
    after = store._current(store._Folder(spark, path))[1]["folders"]
    assert len(before) == store.BUCKETS and sum(after[b] != before[b] for b in before) == 1
    assert kept(spark, path)["k7"][2] == 9 and len(kept(spark, path)) == 500
    assert store.vacuum(spark, path, keep=1) == 1
    assert len(kept(spark, path)) == 500


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    batches = [[(f"k{i}", f"w{w}", "end_turn", w) for i in range(40 * w, 40 * w + 60)] for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda rows: runs.write_replies(replies(spark, rows), path), batches))
    assert sorted(versions) == [1, 2, 3, 4]
    want = {key: (text, stop, n) for rows in batches for key, text, stop, n in rows}
    assert kept(spark, path) == want


def test_a_writer_that_fails_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    runs.write_replies(replies(spark, [("a", "old", "end_turn", 1)]), path)

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(store._Folder, "put", dies)
    with pytest.raises(KeyboardInterrupt):
        runs.write_replies(replies(spark, [("a", "new", "end_turn", 2)]), path)
    monkeypatch.undo()
    assert kept(spark, path) == {"a": ("old", "end_turn", 1)}
    bad = replies(spark, [("a", "new", "end_turn", 2)]).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        runs.write_replies(bad, path)
    assert kept(spark, path) == {"a": ("old", "end_turn", 1)}
    assert [p.name for p in (Path(path) / "manifests").glob("*.json")] == ["000000000001.json"]
    assert runs.write_replies(replies(spark, [("a", "new", "end_turn", 2)]), path) == 2
    assert kept(spark, path)["a"][0] == "new"
