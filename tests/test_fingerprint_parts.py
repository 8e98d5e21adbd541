"""Fingerprints as exact text of values, and their parts per file."""

import random

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import fingerprint

KIND = "a long, b double, c string"


def table(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode(mode).parquet(path)


def rows_of(seed, n=200):
    draw = random.Random(seed)
    values = [0.1, -0.1, 1e300, 5e-324, 2.0**62, -(2.0**70), 1e-30, float("inf"), float("nan"), None]
    return [(draw.choice([None, i]), draw.choice([*values, draw.gauss(0, 1e6)]), f"t{draw.randrange(9)}") for i in range(n)]


def whole(spark, path):
    return fingerprint.fingerprint(spark.read.parquet(path)).first()


def test_parts_of_files_add_up(spark, tmp_path):
    path = f"{tmp_path}/t"
    for seed in range(4):
        table(spark, path, rows_of(seed))
    parts = fingerprint.file_fingerprints(spark.read.parquet(path))
    assert parts.count() == 4
    assert fingerprint.combine(parts).first() == whole(spark, path)
    assert fingerprint.combine(parts.where("rows < 0")).first() == fingerprint.fingerprint(spark.createDataFrame([], KIND)).first()


def test_only_new_and_changed_files_are_read(spark, tmp_path):
    path, side = f"{tmp_path}/t", f"{tmp_path}/side"
    for seed in range(3):
        table(spark, path, rows_of(seed))
    made, n_read = fingerprint.refreshed_parts(spark, path, None)
    assert n_read == 3
    made.write.parquet(f"{side}/0")
    known = spark.read.parquet(f"{side}/0")
    same, n_read = fingerprint.refreshed_parts(spark, path, known)
    assert n_read == 0 and fingerprint.combine(same).first() == whole(spark, path)
    table(spark, path, rows_of(9))
    more, n_read = fingerprint.refreshed_parts(spark, path, known)
    assert n_read == 1 and fingerprint.combine(more).first() == whole(spark, path)
    more.write.parquet(f"{side}/1")
    gone = sorted((tmp_path / "t").glob("*.parquet"))[0]
    gone.unlink()
    less, n_read = fingerprint.refreshed_parts(spark, path, spark.read.parquet(f"{side}/1"))
    assert n_read == 0 and fingerprint.combine(less).first() == whole(spark, path)


@pytest.mark.parametrize("pair", [(0.1, 0.1 + 2**-56), (1e-30, 1.0000000000000002e-30), (2.0**62, 2.0**62 + 1024), (5e-324, 1e-323), (-0.5, 0.5), (1.5, 2.5), (-1.25, -2.25)])
def test_reals_that_differ_have_different_texts(spark, pair):
    df = spark.createDataFrame([(x,) for x in pair], "x double").select(fingerprint.exact_real(F.col("x")).alias("t"))
    assert len({r["t"] for r in df.collect()}) == 2


def test_texts_of_reals(spark):
    values = [0.0, -0.0, 1.5, -1.5, float("nan"), float("inf"), None, 2.0**62, 1e300]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = [r["t"] for r in df.orderBy("i").select(fingerprint.exact_real(F.col("x")).alias("t")).collect()]
    assert got == ["0_0", "0_0", f"1_{2**61}", f"-1_-{2**61}", "nan", "infinity", None, f"{2**62}_0", "1.0e300"]


def test_folders_are_written_by_all_tasks_and_counted_once(spark, tmp_path, monkeypatch):
    """integrity_incremental over four input files: a folder gets several files, and counts as one that is read."""
    from modelwatch.catalog import checking

    kinds = [f"{c} {'timestamp_ntz' if c == 'l_shipdate' else 'string' if c in ('l_returnflag', 'l_linestatus') else 'long'}" for c in checking.PRINT_COLUMNS]
    names = [k.split()[0] for k in kinds]
    row = lambda i: tuple(i % 9 if n == "l_linenumber" else None if k.endswith("timestamp_ntz") else f"{i}" if k.endswith("string") else i for n, k in zip(names, kinds, strict=True))
    data = spark.createDataFrame([row(i) for i in range(400)] + [row(7)], ", ".join(kinds)).repartition(4)
    data.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(checking, "scratch_dir", lambda spark, purpose: f"{tmp_path}/shared/{purpose}")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task for each file
    try:
        got = {r["step"]: r for r in checking.integrity_incremental(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {s: r["n_read"] for s, r in got.items()} == {"first": 3, "unchanged": 0, "one more file": 1}
    lines = spark.read.parquet(f"{tmp_path}/lineitem.parquet").select(*checking.PRINT_COLUMNS)
    for step, rows in (("first", lines.where("l_linenumber % 4 <> 3")), ("unchanged", lines.where("l_linenumber % 4 <> 3")), ("one more file", lines)):
        assert got[step]["dataset_hash"] == fingerprint.fingerprint(rows).first()["dataset_hash"]
    for i in range(4):
        assert len(list((tmp_path / "shared" / "parts" / "table" / str(i)).glob("*.parquet"))) == 4
