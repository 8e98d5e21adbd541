"""Reference samples and perturbations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.catalog import views as v
from modelwatch.catalog.registry import query, rounded
from modelwatch.functions.times import micros
from modelwatch.operators import perturb

KEY = v.LINE_KEY
KEY_TEXT = """CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR)
  || '|' || CAST(l_suppkey AS VARCHAR)"""
HASH_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = ", ".join(KEY)


def bits_sql(text: str, seed) -> str:
    return f"('0x' || substr(md5({text} || '|{seed}'), 1, 13))::BIGINT"


def unit_sql(text: str, seed) -> str:
    return f"({bits_sql(text, seed)} / 4503599627370496.0e0)"


@query(
    "freeze_reference",
    f"""SELECT o_orderkey, o_orderdate, round(o_totalprice + 1e-9, 6) AS o_totalprice FROM (
          SELECT o_orderkey, o_orderdate, coalesce(price, (SELECT median(price) FROM (
                   SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders))) AS o_totalprice,
                 row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rk, count(*) OVER () AS n
          FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders))
        WHERE rk >= floor(n * 0.8e0)""",
)
def freeze_reference(spark, sf):
    orders = v.table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderdate",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
    )
    order = ["o_orderdate", "o_orderkey"]
    out = perturb.freeze_reference(orders, order, [micros("o_orderdate"), F.col("o_orderkey")], impute=["o_totalprice"])
    return rounded(out.select("o_orderkey", "o_orderdate", "o_totalprice"))


@query(
    "seeded_sample",
    f"""SELECT o_orderkey, o_orderdate FROM orders
        ORDER BY {bits_sql('CAST(o_orderkey AS VARCHAR)', 42)}, o_orderkey LIMIT 500""",
)
def seeded_sample(spark, sf):
    return perturb.seeded_sample(v.table(spark, sf, "orders"), ["o_orderkey"], 500).select("o_orderkey", "o_orderdate")


@query(
    "seeded_sample_large",
    f"""SELECT o_orderkey, o_orderdate FROM orders
        QUALIFY row_number() OVER (ORDER BY {bits_sql('CAST(o_orderkey AS VARCHAR)', 42)}, o_orderkey) <= 12000""",
)
def seeded_sample_large(spark, sf):
    """Large enough to take the slot-count path instead of a top-k."""
    out = perturb.seeded_sample(v.table(spark, sf, "orders"), ["o_orderkey"], 12000)
    return out.select("o_orderkey", "o_orderdate")


@query(
    "scale_feature",
    f"SELECT {KEY_SQL}, round(l_quantity * 1.3e0 + 1e-9, 6) AS l_quantity FROM lineitem",
)
def scale_feature(spark, sf):
    return rounded(perturb.scale_feature(v.lines(spark, sf), "l_quantity", 1.3).select(*KEY, "l_quantity"))


@query("shift_feature", f"SELECT {KEY_SQL}, round(l_discount + 0.05e0 + 1e-9, 6) AS l_discount FROM lineitem")
def shift_feature(spark, sf):
    return rounded(perturb.shift_feature(v.lines(spark, sf), "l_discount", 0.05).select(*KEY, "l_discount"))


@query(
    "perturbation_event",
    """SELECT 'covariate_shift_scaling' AS drift_type, 'l_quantity' AS affected_features, 1.3e0 AS magnitude,
              'income grows' AS reason, round(avg(l_quantity) + 1e-9, 6) AS original_mean,
              round(avg(l_quantity * 1.3e0) + 1e-9, 6) AS new_mean FROM lineitem""",
)
def perturbation_event(spark, sf):
    before = v.lines(spark, sf)
    after = perturb.scale_feature(before, "l_quantity", 1.3)
    row = perturb.perturbation_event(
        before, after, "covariate_shift_scaling", "l_quantity", 1.3, "income grows", F.lit("2024-01-01T00:00:00")
    )
    return rounded(
        row.select(
            "drift_type",
            F.array_join("affected_features", ",").alias("affected_features"),
            "magnitude",
            "reason",
            F.col("metadata")["original_mean"].cast("double").alias("original_mean"),
            F.col("metadata")["new_mean"].cast("double").alias("new_mean"),
        )
    )


@query(
    "resample_ratio",
    f"""WITH classes AS (
          SELECT CAST(doc_id AS VARCHAR) AS doc_id, toxic, {bits_sql('CAST(doc_id AS VARCHAR)', 42)} AS u FROM labels),
        numbered AS (
          SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY u, doc_id) - 1 AS nth,
                 count(*) OVER (PARTITION BY toxic) AS size FROM classes),
        sizes AS (SELECT count(*) AS total, CAST(floor(count(*) * 0.4e0) AS BIGINT) AS pos FROM classes),
        draws AS (
          SELECT unnest(range(pos)) AS draw, 1 AS toxic FROM sizes
          UNION ALL SELECT unnest(range(total - pos)) AS draw, 0 AS toxic FROM sizes)
        SELECT d.draw, d.toxic, n.doc_id FROM draws d JOIN numbered n ON n.toxic = d.toxic
          AND n.nth = CAST(floor({unit_sql('CAST(d.draw AS VARCHAR)', "42c' || CAST(d.toxic AS VARCHAR) || '")}
                                 * n.size) AS BIGINT)""",
)
def resample_ratio(spark, sf):
    rows = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    return perturb.resample_ratio(rows, "toxic", 0.4, ["doc_id"]).select("draw", "toxic", "doc_id")


@query(
    "label_flip",
    f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, {unit_sql('CAST(doc_id AS VARCHAR)', 42)} < 0.1e0 AS label_flipped,
               CASE WHEN {unit_sql('CAST(doc_id AS VARCHAR)', 42)} < 0.1e0 THEN 1 - quality ELSE quality END AS quality
        FROM labels""",
)
def label_flip(spark, sf):
    rows = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality")
    return perturb.flip_labels(rows, "quality", 0.1, ["doc_id"])


@query(
    "gaussian_noise",
    f"""SELECT {KEY_SQL}, round(l_extendedprice + 500.0e0 * sqrt(-2.0e0 * ln(1.0e0 - {unit_sql(KEY_TEXT, '42r')}))
               * cos(6.283185307179586e0 * {unit_sql(KEY_TEXT, '42a')}) + 1e-9, 6) AS l_extendedprice
        FROM lineitem""",
)
def gaussian_noise(spark, sf):
    out = perturb.add_noise(v.lines(spark, sf), "l_extendedprice", 500.0, HASH_KEY)
    return rounded(out.select(*KEY, "l_extendedprice"))


@query(
    "partial_labels",
    f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, quality FROM labels
        QUALIFY row_number() OVER (ORDER BY {bits_sql('CAST(doc_id AS VARCHAR)', 42)}, CAST(doc_id AS VARCHAR))
          <= floor(count(*) OVER () * 0.3e0)""",
)
def partial_labels(spark, sf):
    rows = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality")
    return perturb.sample_fraction(rows, ["doc_id"], 30)


@query(
    "assign_times",
    f"""SELECT doc_id, TIMESTAMP '2020-01-01 00:00:00' + to_microseconds(CAST(floor(
                 {unit_sql('CAST(doc_id AS VARCHAR)', 42)} * 126230400000000) AS BIGINT)) AS application_date
        FROM documents""",
)
def assign_times(spark, sf):
    rows = v.table(spark, sf, "documents").select("doc_id")
    return perturb.assign_times(rows, "2020-01-01 00:00:00", "2024-01-01 00:00:00", ["doc_id"])


STRESS_SOURCE = """v_people AS (
  SELECT c_custkey, c_acctbal AS balance, CAST(c_custkey % 7 AS BIGINT) AS visits, (c_custkey % 100) / 100.0e0 AS share,
         CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS DOUBLE) / count(*) OVER () AS progress,
         CAST(c_custkey AS VARCHAR) AS k
  FROM customer)"""
STRESS_EFFECTS = [
    perturb.Effect(1, "balance", "scale", 0.0, 0.5, base=1.0, slope=0.25),
    perturb.Effect(1, "visits", "add", 1, 3),
    perturb.Effect(2, "share", "raise", 0.125, 0.25),
    perturb.Effect(2, "balance", "scale", 0.5, 1.0),
    perturb.Effect(3, "balance", "scale", 9.0, 9.0),
]
STRESS_BOUNDS = {"balance": (-500.0, 12_000.0), "visits": (0, 8), "share": (0.0, 1.0)}


def _stress_sql() -> str:
    """The first two phases, one derived table each; the third is not asked for."""
    u = lambda i: unit_sql("k", f"42e{i}")
    one = f"""p1 AS (SELECT c_custkey, k, share,
        least(greatest(balance * (1.0e0 + 0.25e0 * progress + {u(0)} * 0.5e0), -500), 12000) AS balance,
        CAST(least(greatest(visits + 1 + floor({u(1)} * 3), 0), 8) AS BIGINT) AS visits FROM v_people)"""
    two = f"""p2 AS (SELECT c_custkey, visits,
        least(greatest(share + 0.125e0 + {u(2)} * 0.125e0, 0), 1) AS share,
        least(greatest(balance * (0.5e0 + {u(3)} * 0.5e0), -500), 12000) AS balance FROM p1)"""
    return v.with_views(STRESS_SOURCE, one, two) + (
        "SELECT c_custkey, round(balance + 1e-9, 6) AS balance, visits, round(share + 1e-9, 6) AS share FROM p2"
    )


@query("progressive_stress", _stress_sql())
def progressive_stress(spark, sf):
    key = F.col("c_custkey")
    people = v.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("balance"), (key % 7).alias("visits"), (key % 100 / 100.0).alias("share")
    )
    out = perturb.progressive_stress(people, 2, ["c_custkey"], ["c_custkey"], STRESS_EFFECTS, STRESS_BOUNDS, integers=["visits"])
    return rounded(out)
