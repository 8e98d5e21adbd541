"""Order statistics by selection, and the median and freeze operators on top of them."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import cleaning, perturb, selection


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}").repartition(4)


@pytest.fixture
def scans(monkeypatch):
    """Number of passes that were made over the input."""
    made = []
    for name in ("_read_off", "_narrow"):
        inner = getattr(selection, name)
        monkeypatch.setattr(selection, name, lambda *a, inner=inner, name=name: made.append(name) or inner(*a))
    return made


CASES = {
    "one": [3.0],
    "two": [1.0, 4.0],
    "odd": [5.0, 1.0, 3.0],
    "ties": [2.0] * 500 + [1.0] * 499,
    "gaps": [None, float("nan"), 1.0, None, 9.0, 2.0],
    "many": [random.Random(1).gauss(0, 1) ** 3 for _ in range(20_000)],
    "skewed": [0.0] * 9_000 + [random.Random(2).random() for _ in range(1_001)],
    "none": [None, float("nan")],
}


@pytest.mark.parametrize("options", [{}, {"accuracy": 20}, {"accuracy": 50, "most_rows": 10}])
def test_medians_of_all_columns(spark, scans, options):
    for values in CASES.values():
        known = [v for v in values if v is not None and v == v]
        got = cleaning.medians(frame(spark, values), ["v"], **options)["v"]
        assert got == (statistics.median(known) if known else None)
    if not options:
        assert set(scans) == {"_read_off"}


def test_fifty_columns_take_two_scans(spark, scans, monkeypatch):
    """One sketch and one pass that reads the medians off; no exchange carries rows."""
    draw = random.Random(4)
    names = [f"c{i}" for i in range(50)]
    data = [[draw.choice([None, draw.gauss(i, 3)]) for i in range(50)] for _ in range(800)]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))
    sketches = []
    inner = type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: sketches.append(1) or inner(self, *a))
    got = cleaning.medians(df, names)
    assert len(sketches) == 1 and scans == ["_read_off"]
    for i, n in enumerate(names):
        assert got[n] == statistics.median(r[i] for r in data if r[i] is not None)


def test_mixed_kinds(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 10L, 0.5D), (2, 20L, 1.5D), (4, 40L, NULL) AS t(a, b, c)")
    assert cleaning.medians(df, ["a", "b", "c"]) == {"a": 2.0, "b": 20.0, "c": 1.0}


@pytest.mark.parametrize("share", [0.0, 0.25, 0.8, 1.0])
@pytest.mark.parametrize("options", [{}, {"accuracy": 30, "most_rows": 20}])
def test_rows_from_a_rank_on(spark, share, options):
    draw = random.Random(9)
    rows = [(i, draw.choice([None, *range(7)])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, day long").repartition(3)
    got = {r["id"] for r in selection.from_rank(df, [F.col("day"), F.col("id")], share, **options).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0] for r in ordered[int(len(rows) * share) :]}


def test_frozen_rows_are_one_filter_over_the_input(spark, tmp_path):
    frame(spark, CASES["many"]).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    frozen = perturb.freeze_reference(stored, ["v", "i"], fraction=0.9)
    plan = frozen._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    assert frozen.count() == 2_000 and frozen.agg(F.min("v")).first()[0] == sorted(CASES["many"])[18_000]


def test_nothing_to_select(spark):
    none = frame(spark, [])
    assert cleaning.medians(none, ["v"]) == {"v": None}
    assert selection.from_rank(none, [F.col("v")], 0.8).count() == 0


@pytest.mark.parametrize("kind", ["double", "float", "long", "int", "decimal(12,2)"])
def test_cells_are_counted_without_a_row_for_each(spark, monkeypatch, kind):
    """The second scan makes no row for every cell of a row, and no cell below a range is handed on."""
    from pyspark.sql import types as T

    draw = random.Random(6)
    made = []
    monkeypatch.setattr(F, "inline", lambda *a: pytest.fail("a row for each cell"))
    inner = selection.inside_counts
    monkeypatch.setattr(selection, "inside_counts", lambda *a: made.append(inner(*a)) or made[-1])
    values = [(draw.choice([None, draw.randrange(-5_000, 5_000)]), draw.randrange(3)) for _ in range(9_000)]
    df = spark.createDataFrame(values, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind)).repartition(3)
    found = selection.select_ranks(df, {"a": F.col("a"), "b": F.col("b")}, 0.5, lambda n: [(n - 1) // 2, n // 2], accuracy=100)
    for i, n in enumerate("ab"):
        known = sorted(v[i] for v in values if v[i] is not None)
        ranks = [(len(known) - 1) // 2, len(known) // 2]
        assert found[n].values == [known[r] for r in ranks] and found[n].below == [known.index(known[r]) for r in ranks]
    assert len(made) == 1 and isinstance(made[0].schema["value"].dataType, T.NumericType)
    assert made[0].where("value IS NOT NULL").agg(F.sum("n")).first()[0] < 9_000 + 9_000 // 10
