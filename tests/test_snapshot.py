"""Commits on shared storage, and the label table that is kept by them from a stream."""

import random

import pytest
from pyspark.sql import functions as F

from modelwatch.sources import commits
from modelwatch.streaming import jobs, snapshot

KIND = "prediction_id string, true_label int, updated_at long"


def batch(spark, rows):
    return spark.createDataFrame(rows, KIND)


def merge(spark, path, rows, number, **options):
    options = {"n_buckets": 8, **options}
    return snapshot.merge_batch(batch(spark, rows), path, number, "prediction_id", ["updated_at"], **options)


def held(spark, path):
    return {r["prediction_id"]: (r["true_label"], r["updated_at"]) for r in snapshot.read_snapshot(spark, path).collect()}


def plain(log):
    out = {}
    for key, label, at in log:
        if key is not None and (key not in out or (at, label) > (out[key][1], out[key][0])):
            out[key] = (label, at)
    return out


def test_commits_follow_each_other(spark, tmp_path):
    root = str(tmp_path)
    start = commits.latest(spark, root)
    assert (start.number, start.state) == (0, {})
    one = commits.commit(spark, root, start, {"x": 1})
    two = commits.commit(spark, root, one, {"x": 2})
    assert commits.latest(spark, root) == two and commits.version(spark, root, 1) == one
    with pytest.raises(commits.StaleVersion):
        commits.commit(spark, root, one, {"x": 3})
    assert commits.latest(spark, root).state == {"x": 2}
    assert [[v.number for v in part] for part in commits.forget(spark, root, 1)] == [[1], [2]] and commits.folders(spark, f"{root}/commits") == ["000000000002.json"]


def test_a_rename_never_replaces_a_commit(spark, tmp_path, monkeypatch):
    """Two writers that both saw the same newest version: the second finds the file there."""
    root = str(tmp_path)
    start = commits.latest(spark, root)
    commits.commit(spark, root, start, {"x": 1})
    monkeypatch.setattr(commits, "_numbers", lambda *_: [])
    with pytest.raises(commits.StaleVersion):
        commits.commit(spark, root, start, {"x": 2})
    monkeypatch.undo()
    assert commits.latest(spark, root).state == {"x": 1}


def test_batches_out_of_order_and_repeated(spark, tmp_path):
    draw, path, log = random.Random(3), str(tmp_path), []
    for number in range(5):
        rows = [(f"p{draw.randrange(40)}", draw.randrange(2), draw.randrange(50)) for _ in range(30)] + [(None, 1, 1)]
        rows += draw.sample(rows, 5)
        log += rows
        merge(spark, path, rows, number)
        assert held(spark, path) == plain(log)
    before = commits.latest(spark, path)
    merge(spark, path, [("p1", 9, 999)], 4)  # a replay of a batch that is in already
    assert commits.latest(spark, path) == before
    merge(spark, path, log, 0, source="another")
    assert held(spark, path) == plain(log)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path)
    first = merge(spark, path, [(f"p{i}", 0, 1) for i in range(200)], 0)
    second = merge(spark, path, [("p7", 1, 2)], 1)
    moved = [b for b in first.state["buckets"] if first.state["buckets"][b] != second.state["buckets"][b]]
    assert len(first.state["buckets"]) == 8 and len(moved) == 1
    files = lambda v, b: sorted((tmp_path / "data" / v.state["buckets"][b]).glob(f"*={b}/*.parquet"))
    assert all(files(first, b) == files(second, b) for b in first.state["buckets"] if b not in moved)
    assert held(spark, path)["p7"] == (1, 2) and len(held(spark, path)) == 200
    old = snapshot.read_snapshot(spark, path, at=first)
    assert old.where("prediction_id = 'p7'").first()["true_label"] == 0


def test_a_failed_attempt_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    merge(spark, path, [("a", 0, 1), ("b", 0, 1)], 0)

    def lost(*_):
        raise OSError("driver lost")

    monkeypatch.setattr(commits, "commit", lost)
    with pytest.raises(OSError):
        merge(spark, path, [("a", 1, 2)], 1)
    monkeypatch.undo()
    assert held(spark, path) == {"a": (0, 1), "b": (0, 1)}
    assert len(commits.folders(spark, f"{path}/data")) == 2
    merge(spark, path, [("a", 1, 2)], 1)
    assert held(spark, path) == {"a": (1, 2), "b": (0, 1)}
    assert len(commits.folders(spark, f"{path}/data")) == 2  # the attempt's folder went with the next batch


def test_old_folders_go(spark, tmp_path):
    path = str(tmp_path)
    for number in range(6):
        merge(spark, path, [("a", number, number)], number, keep_versions=2)
    assert len(commits.folders(spark, f"{path}/data")) == 2 and held(spark, path) == {"a": (5, 5)}


def test_empty_batches_and_tables(spark, tmp_path):
    path = str(tmp_path)
    kind = batch(spark, []).schema
    assert snapshot.read_snapshot(spark, path, schema=kind).count() == 0
    merge(spark, path, [], 0)
    assert held(spark, path) == {} and commits.latest(spark, path).state["sources"] == {"stream": 0}
    with pytest.raises(ValueError, match="buckets"):
        merge(spark, path, [("a", 1, 1)], 1, n_buckets=4)


def test_a_drained_stream(spark, tmp_path):
    for part in range(4):
        rows = [(f"p{i}", (i + part) % 2, (i * 7 + part * 3) % 11) for i in range(20)]
        batch(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", batch(spark, []).schema, max_files=1)
    jobs.drain(snapshot.label_snapshot(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint", n_buckets=4))
    log = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/in").collect()]
    assert held(spark, f"{tmp_path}/table") == plain(log)
    assert commits.latest(spark, f"{tmp_path}/table").state["sources"] == {"stream": 3}


def test_end_marker_drains_an_outer_join(spark, tmp_path):
    from modelwatch.streaming import monitor

    spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01'), ('b', TIMESTAMP '2024-01-02') AS t(prediction_id, timestamp)").write.parquet(f"{tmp_path}/p")
    spark.sql("SELECT 'a' AS prediction_id, 1 AS true_label, TIMESTAMP '2024-01-03' AS label_timestamp").write.parquet(f"{tmp_path}/l")
    read = lambda name: jobs.file_stream(spark, f"{tmp_path}/{name}", spark.read.parquet(f"{tmp_path}/{name}").schema)
    left = jobs.with_end_marker(read("p"), f"{tmp_path}/pe", "timestamp", "2100-01-01")
    right = jobs.with_end_marker(read("l"), f"{tmp_path}/le", "label_timestamp", "2100-01-01")
    joined = monitor.attach_labels(left, right).select("prediction_id", "true_label")
    jobs.drain(jobs.append_to(joined, f"{tmp_path}/out", f"{tmp_path}/cp"))
    out = spark.read.parquet(f"{tmp_path}/out").where(F.col("prediction_id") != jobs.END)
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", None)]
