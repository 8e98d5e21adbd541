"""Bucketed ordered computations equal the plain ones, whatever the cuts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            # One group and one value hold far more than a third of all rows.
            "g": rng.choice(["hot", "a", "b"], n, p=[0.7, 0.2, 0.1]),
            "v": np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(size=n), 2)),
            "w": rng.integers(0, 9, n),
        }
    )
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("size", [37, 500, 10**6])
def test_running_totals_match_pandas(rows, size):
    df, pdf = rows
    cuts = ordered.plan_cuts(df, ["v"], size, distinct=False)["v"]
    counts = ordered.with_bucket(df, "v", cuts).groupBy("g", ordered.BUCKET, "v").agg(F.sum("w").alias("w"))
    out = ordered.running_totals(
        counts, ["g"], ["v"], sums={"upto": "w"}, totals={"all": "w"}, next_value={"following": "v"}
    ).toPandas()
    want = pdf.groupby(["g", "v"], as_index=False)["w"].sum().sort_values(["g", "v"])
    want["upto"] = want.groupby("g")["w"].cumsum()
    want["all"] = want.groupby("g")["w"].transform("sum")
    want["following"] = want.groupby("g")["v"].shift(-1)
    got = out.sort_values(["g", "v"])[["g", "v", "w", "upto", "all", "following"]].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want.reset_index(drop=True), check_dtype=False)
    assert (size < 4000) == (len(cuts) > 0)


@pytest.mark.parametrize("size", [50, 10**6])
def test_row_ranks_with_hot_ties(rows, size):
    df, pdf = rows
    out = ordered.row_ranks(df, ["g"], ["v", "id"], name="rk", total="n", rows_per_bucket=size).toPandas()
    want = pdf.sort_values(["g", "v", "id"])
    want["rk"] = want.groupby("g").cumcount()
    want["n"] = want.groupby("g")["id"].transform("count")
    got = out.set_index("id").loc[want["id"]]
    assert got["rk"].tolist() == want["rk"].tolist()
    assert got["n"].tolist() == want["n"].tolist()


@pytest.mark.parametrize("size", [60, 10**6])
def test_previous_values(rows, size):
    df, pdf = rows
    cuts = ordered.plan_cuts(df, ["id"], size, distinct=False)["id"]
    bucket = ordered.BUCKET if cuts else None
    placed = ordered.with_bucket(df, "id", cuts)
    out = ordered.previous_values(placed, ["g"], ["id"], {"before": "w"}, bucket=bucket).toPandas()
    want = pdf.sort_values(["g", "id"])
    want["before"] = want.groupby("g")["w"].shift(1)
    got = out.set_index("id").loc[want["id"]]["before"]
    assert got.fillna(-1).tolist() == want["before"].fillna(-1).tolist()


@pytest.mark.parametrize("size", [20, 10**6])
def test_exact_quantiles_match_numpy(rows, size):
    df, pdf = rows
    cuts = ordered.plan_cuts(df, ["v"], size)["v"]
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9}
    out = ordered.exact_quantiles(df, ["g"], "v", probs, cuts).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, q in probs.items():
            assert out.loc[g, name] == pytest.approx(np.quantile(part["v"], q))


def test_result_does_not_depend_on_partitions(rows):
    df, _ = rows
    seen = set()
    for parts in (1, 3, 11):
        shuffled = df.repartition(parts).orderBy(F.rand(parts))
        ranks = ordered.row_ranks(shuffled, ["g"], ["v", "id"], name="rk", rows_per_bucket=100)
        seen.add(ranks.agg(F.sum(F.col("rk") * (F.col("id") + 1))).first()[0])
    assert len(seen) == 1


def test_empty_input(spark):
    empty = spark.createDataFrame([], "g string, v double, id long")
    assert ordered.plan_cuts(empty, ["v"]) == {"v": []}
    assert ordered.row_ranks(empty, ["g"], ["v", "id"]).count() == 0


@pytest.mark.parametrize("size", [3, 10**6])
def test_null_order_and_group_values_are_kept(spark, size):
    data = [(None, None, i) for i in range(4)] + [("a", float(i % 5), i + 4) for i in range(20)]
    df = spark.createDataFrame(data, "g string, v double, id long")
    out = ordered.row_ranks(df, ["g"], ["v", "id"], name="rk", rows_per_bucket=size)
    assert sorted(r["rk"] for r in out.filter("g IS NULL").collect()) == [0, 1, 2, 3]
    assert sorted(r["rk"] for r in out.filter("g = 'a'").collect()) == list(range(20))


def test_ranks_by_other_than_numbers(spark):
    """Texts, dates, times and flags as order columns, below and above the switch."""
    rows = [(i, f"{'é' if i % 3 else 'e'}{i % 7:02d}{i * 37 % 101:03d}", i % 2 == 0) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, name string, flag boolean")
    df = df.withColumns({"day": F.date_add(F.lit("2024-01-01"), (F.col("id") % 5).cast("int")), "at": F.timestamp_seconds(F.col("id") * 977 % 350)})
    for order in (["name", "id"], ["day", "name"], ["at", "id"], ["flag", "id"]):
        want = [r["id"] for r in df.orderBy(*order).collect()]
        for size in (None, 10):
            got = ordered.row_ranks(df, [], order, name="rk", rows_per_bucket=size).orderBy("rk").collect()
            assert [r["id"] for r in got] == want and [r["rk"] for r in got] == list(range(150))
    with pytest.raises(TypeError):
        ordered.row_ranks(df.withColumn("a", F.array("id")), [], ["a"])
