"""Contracts, keys, references, profiles and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.catalog import views as v
from modelwatch.catalog.registry import query
from modelwatch.operators import fingerprint, perturb, validate
from modelwatch.session import scratch_dir


def log_with_features(spark, sf):
    """Line items as a log with bad values in some rows."""
    return v.lines(spark, sf).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("prediction_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.when(F.col("l_quantity") < 49, F.col("l_returnflag")).alias("model_version"),
        (F.col("l_linenumber") % 3).alias("prediction"),
        (F.col("l_quantity") / 45.0).alias("probability"),
        (F.col("l_quantity") + 12).cast("int").alias("age"),
        (F.col("l_discount") - 0.01).alias("DebtRatio"),
        (F.col("l_tax") * 100).alias("MonthlyIncome"),
    )


LOG_SQL = """v_log AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS prediction_id, l_shipdate AS "timestamp",
         CASE WHEN l_quantity < 49 THEN l_returnflag END AS model_version, l_linenumber % 3 AS prediction,
         l_quantity / 45.0 AS probability, CAST(l_quantity + 12 AS INTEGER) AS age,
         l_discount - 0.01e0 AS debt, l_tax * 100 AS income
  FROM lineitem)"""
LOG_FEATURES = ["age", "DebtRatio", "MonthlyIncome"]


@query(
    "contract_predictions",
    v.with_views(LOG_SQL)
    + """SELECT 'timestamp not null' AS rule, count(*) FILTER ("timestamp" IS NULL) AS violations FROM v_log
         UNION ALL SELECT 'prediction_id not null', count(*) FILTER (prediction_id IS NULL) FROM v_log
         UNION ALL SELECT 'model_version not null', count(*) FILTER (model_version IS NULL) FROM v_log
         UNION ALL SELECT 'prediction in (0, 1)', count(*) FILTER (prediction NOT IN (0, 1)) FROM v_log
         UNION ALL SELECT 'probability in [0, 1]', count(*) FILTER (probability NOT BETWEEN 0 AND 1) FROM v_log
         UNION ALL SELECT 'age in [18, 120]', count(*) FILTER (age NOT BETWEEN 18 AND 120) FROM v_log
         UNION ALL SELECT 'DebtRatio >= 0', count(*) FILTER (debt < 0) FROM v_log
         UNION ALL SELECT 'MonthlyIncome >= 0', count(*) FILTER (income < 0) FROM v_log
         UNION ALL SELECT 'unique (prediction_id)', (SELECT count(*) FROM (
           SELECT prediction_id FROM v_log GROUP BY prediction_id HAVING count(*) > 1))""",
)
def contract_predictions(spark, sf):
    rows = log_with_features(spark, sf)
    return validate.contract_report(rows, validate.prediction_rules(LOG_FEATURES), [["prediction_id"]])


@query(
    "contract_labels",
    v.with_views(v.LABELS_SQL)
    + """SELECT 'prediction_id not null' AS rule, count(*) FILTER (prediction_id IS NULL) AS violations FROM v_labels
         UNION ALL SELECT 'label_timestamp not null', count(*) FILTER (label_timestamp IS NULL) FROM v_labels
         UNION ALL SELECT 'label_source not null', count(*) FILTER (label_source IS NULL) FROM v_labels
         UNION ALL SELECT 'true_label in (0, 1)', count(*) FILTER (true_label NOT IN (0, 1)) FROM v_labels""",
)
def contract_labels(spark, sf):
    return validate.contract_report(v.labels(spark, sf), validate.label_rules())


REASONS_SQL = """list_filter([
  CASE WHEN "timestamp" IS NULL THEN 'timestamp not null' END,
  CASE WHEN prediction_id IS NULL THEN 'prediction_id not null' END,
  CASE WHEN model_version IS NULL THEN 'model_version not null' END,
  CASE WHEN prediction NOT IN (0, 1) THEN 'prediction in (0, 1)' END,
  CASE WHEN probability NOT BETWEEN 0 AND 1 THEN 'probability in [0, 1]' END,
  CASE WHEN age NOT BETWEEN 18 AND 120 THEN 'age in [18, 120]' END,
  CASE WHEN debt < 0 THEN 'DebtRatio >= 0' END,
  CASE WHEN income < 0 THEN 'MonthlyIncome >= 0' END], lambda x: x IS NOT NULL)"""


@query(
    "reject_rows",
    v.with_views(LOG_SQL)
    + f"""SELECT prediction_id, "timestamp", array_to_string({REASONS_SQL}, '; ') AS reasons FROM v_log
          WHERE len({REASONS_SQL}) > 0""",
)
def reject_rows(spark, sf):
    _, bad = validate.split_rejects(log_with_features(spark, sf), validate.prediction_rules(LOG_FEATURES))
    return bad.select("prediction_id", "timestamp", F.array_join("reject_reasons", "; ").alias("reasons"))


@query(
    "accepted_rows",
    v.with_views(LOG_SQL)
    + f"""SELECT model_version, prediction, count(*) AS n FROM v_log WHERE len({REASONS_SQL}) = 0
          GROUP BY model_version, prediction""",
)
def accepted_rows(spark, sf):
    good, _ = validate.split_rejects(log_with_features(spark, sf), validate.prediction_rules(LOG_FEATURES))
    return good.groupBy("model_version", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "enum_checks",
    v.with_views(v.DECISIONS_SQL, v.VERSIONS_SQL)
    + """SELECT 'trigger_reason in (scheduled, manual, drift_alert)' AS rule,
                count(*) FILTER (trigger_reason NOT IN ('scheduled', 'manual', 'drift_alert')) AS violations
         FROM v_decisions
         UNION ALL SELECT 'action in (train, skip, promote, reject)',
                count(*) FILTER (action NOT IN ('train', 'skip', 'promote', 'reject')) FROM v_decisions
         UNION ALL SELECT 'o_orderpriority in (1-URGENT, 2-HIGH)',
                (SELECT count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
         UNION ALL SELECT 'stage in (Staging, Production, Archived, None)',
                (SELECT count(*) FROM v_versions WHERE stage NOT IN ('Staging', 'Production', 'Archived', 'None'))""",
)
def enum_checks(spark, sf):
    rules = validate.audit_rules()
    words = validate.one_of("o_orderpriority", ["1-URGENT", "2-HIGH"])
    return (
        validate.check_rules(v.decisions(spark, sf), rules["decisions"])
        .unionByName(validate.check_rules(v.table(spark, sf, "orders"), [words]))
        .unionByName(validate.check_rules(v.versions(spark, sf), rules["versions"]))
    )


@query(
    "uniqueness_checks",
    v.with_views(v.DECISIONS_SQL, v.VERSIONS_SQL)
    + """SELECT 'unique (timestamp)' AS rule, count(*) AS violations FROM (
           SELECT "timestamp" FROM v_decisions GROUP BY 1 HAVING count(*) > 1)
         UNION ALL SELECT 'unique (model_name, version)', count(*) FROM (
           SELECT model_name, version FROM v_versions GROUP BY 1, 2 HAVING count(*) > 1)
         UNION ALL SELECT 'one production version per model', count(*) FROM (
           SELECT model_name FROM v_versions WHERE stage = 'Production' GROUP BY 1 HAVING count(*) > 1)
         UNION ALL SELECT 'decision exists', count(*) FROM v_versions
           WHERE decision_id NOT IN (SELECT id FROM v_decisions WHERE trigger_reason <> 'manual')""",
)
def uniqueness_checks(spark, sf):
    decisions, versions = v.decisions(spark, sf), v.versions(spark, sf)
    some = decisions.filter("trigger_reason <> 'manual'")
    return (
        validate.check_unique(decisions, ["timestamp"])
        .unionByName(validate.check_unique(versions, ["model_name", "version"]))
        .unionByName(validate.one_production_per_model(versions))
        .unionByName(validate.check_reference(versions, some, "decision_id", "id", "decision exists"))
    )


@query(
    "dataset_profile",
    """SELECT CAST(sum(n) AS BIGINT) AS dataset_rows, 5 AS dataset_columns, CAST(sum(n * nulls) AS BIGINT) AS missing_cells,
              CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
       FROM (SELECT count(*) AS n, max(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END) AS nulls FROM (
         SELECT l_discount, l_linenumber,
                CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS l_quantity, l_returnflag, l_linestatus
         FROM lineitem) GROUP BY l_discount, l_linenumber, l_quantity, l_returnflag, l_linestatus)""",
)
def dataset_profile(spark, sf):
    rows = v.lines(spark, sf).select(
        "l_discount",
        "l_linenumber",
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("l_quantity"),
        "l_returnflag",
        "l_linestatus",
    )
    return fingerprint.profile(rows)


@query(
    "dataset_profile_all",
    """WITH d AS (
         SELECT * REPLACE (CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS l_quantity, CASE WHEN l_tax > 0 THEN l_tax END AS l_tax)
         FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1))
       SELECT (SELECT count(*) FROM d) AS dataset_rows, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE lineitem)) AS dataset_columns,
              (SELECT CAST(count(*) - count(l_quantity) + count(*) - count(l_tax) AS BIGINT) FROM d) AS missing_cells,
              (SELECT CAST((SELECT count(*) FROM d) - count(*) AS BIGINT) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows""",
)
def dataset_profile_all(spark, sf):
    """All columns of all rows, with gaps in two of them and the first line of every order once more."""
    lines = v.lines(spark, sf)
    rows = lines.unionByName(lines.where("l_linenumber = 1"))
    gaps = {"l_quantity": F.when(F.col("l_returnflag") != "A", F.col("l_quantity")), "l_tax": F.when(F.col("l_tax") > 0, F.col("l_tax"))}
    return fingerprint.profile(rows.withColumns(gaps))


# The columns of the line items by kind, as the fingerprint writes them.
WHOLE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
REAL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXT = ["l_returnflag", "l_linestatus"]
TIMES = ["l_shipdate"]
PRINT_COLUMNS = [*WHOLE, *REAL, *TEXT, *TIMES]


def fingerprint_sql(rows: str, whole=WHOLE, real=REAL, text=TEXT, times=TIMES) -> str:
    """Columns in name order, each with the lengths of its name and value; reals as their whole part and the
    rest in units of 2**-62; times as microseconds."""
    cells = {c: f"CAST({c} AS VARCHAR)" for c in whole} | {c: c for c in text}
    cells |= {
        c: f"CAST(CAST(trunc({c}) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(({c} - trunc({c})) * 4611686018427387904e0 AS BIGINT) AS VARCHAR)"
        for c in real
    }
    cells |= {c: f"CAST(epoch_us({c}) AS VARCHAR)" for c in times}
    row = " || ';' || ".join(
        f"'{len(c)}:{c}=' || coalesce(length({cells[c]}) || ':' || {cells[c]}, '-')" for c in sorted(cells)
    )
    return f"""SELECT n AS "rows", CAST(s AS VARCHAR) AS hash_sum, x AS hash_xor,
                      sha256(concat_ws('|', CAST(n AS VARCHAR), CAST(s AS VARCHAR), CAST(x AS VARCHAR)))
                        AS dataset_hash
               FROM (SELECT count(*) AS n, sum(h) AS s, bit_xor(h) AS x FROM (
                 SELECT ('0x' || substr(md5({row}), 1, 15))::BIGINT AS h FROM {rows}))"""


@query("fingerprint", fingerprint_sql("lineitem"))
def fingerprint_query(spark, sf):
    return fingerprint.fingerprint(v.lines(spark, sf), PRINT_COLUMNS)


@query(
    "integrity_check",
    f"""WITH a AS ({fingerprint_sql('lineitem')}),
             b AS ({fingerprint_sql("(SELECT * FROM lineitem WHERE l_orderkey <> 7)")})
        SELECT 'unchanged' AS copy, TRUE AS intact
        UNION ALL SELECT 'rows removed', a.dataset_hash = b.dataset_hash FROM a, b
        UNION ALL SELECT 'one value moved by 1e-9', FALSE""",
)
def integrity_check(spark, sf):
    """A fingerprint of shuffled rows and columns matches the stored one; with rows removed it does not."""
    lines = v.lines(spark, sf).select(*PRINT_COLUMNS)
    stored = fingerprint.fingerprint(lines).first()["dataset_hash"]
    copies = {"unchanged": lines.select(*reversed(PRINT_COLUMNS)), "rows removed": lines.filter("l_orderkey <> 7")}
    moved = F.when(F.col("l_linenumber") == 1, F.col("l_tax") + 1e-9).otherwise(F.col("l_tax"))
    copies["one value moved by 1e-9"] = lines.withColumn("l_tax", moved)
    out = None
    for name, rows in copies.items():
        part = fingerprint.fingerprint(rows).select(
            F.lit(name).alias("copy"), (F.col("dataset_hash") == stored).alias("intact")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "integrity_incremental",
    f"""SELECT p.*, f.step, f.n_read FROM (VALUES ('first', 3), ('unchanged', 0), ('one more file', 1)) AS f(step, n_read)
        JOIN (SELECT 'all' AS part, * FROM ({fingerprint_sql('lineitem')})
              UNION ALL SELECT 'most', * FROM ({fingerprint_sql('(SELECT * FROM lineitem WHERE l_linenumber % 4 <> 3)')})) p
          ON p.part = CASE f.step WHEN 'one more file' THEN 'all' ELSE 'most' END""",
)
def integrity_incremental(spark, sf):
    """Three folders of files are fingerprinted, checked again unread, and checked with a fourth that alone is read.

    Each task of the scan writes a file of its own, so a folder has as many as its rows need.
    """
    root = scratch_dir(spark, "parts")
    lines = v.lines(spark, sf).select(*PRINT_COLUMNS)
    number = F.col("l_linenumber") % 4
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    out = None
    known = None
    for step, files in (("first", (0, 1, 2)), ("unchanged", ()), ("one more file", (3,))):
        for i in files:
            lines.where(number == i).write.parquet(f"{root}/table/{i}")
        parts, n_read = fingerprint.refreshed_parts(spark, f"{root}/table", known, PRINT_COLUMNS, unit=folder)
        parts.write.parquet(f"{root}/parts/{step.replace(' ', '-')}")
        known = spark.read.parquet(f"{root}/parts/{step.replace(' ', '-')}")
        part = F.lit("all" if step == "one more file" else "most").alias("part")
        row = fingerprint.combine(known).select(part, "rows", "hash_sum", "hash_xor", "dataset_hash", F.lit(step).alias("step"), F.lit(n_read).alias("n_read"))
        out = row if out is None else out.unionByName(row)
    return out


ORDER_KINDS = {"whole": ["o_orderkey", "o_custkey"], "real": ["o_totalprice"], "text": ["o_orderstatus", "o_orderpriority"], "times": ["o_orderdate"]}
ORDER_COLUMNS = [c for kind in ORDER_KINDS.values() for c in kind]


@query(
    "reference_metadata",
    f"""WITH ranked AS (
          SELECT {', '.join(ORDER_COLUMNS)}, row_number() OVER (ORDER BY o_orderkey) - 1 AS rk, count(*) OVER () AS n
          FROM orders),
        frozen AS (SELECT * FROM ranked WHERE rk >= floor(n * 0.8e0)),
        printed AS ({fingerprint_sql('frozen', **ORDER_KINDS)})
        SELECT "rows" AS num_samples, {len(ORDER_COLUMNS)} AS num_features, dataset_hash AS reference_hash,
               'training_test_split' AS source, '{','.join(ORDER_COLUMNS)}' AS features FROM printed""",
)
def reference_metadata(spark, sf):
    orders = v.table(spark, sf, "orders").select(*ORDER_COLUMNS)
    frozen = perturb.freeze_reference(orders, ["o_orderkey"])
    digest = fingerprint.fingerprint(frozen).select("dataset_hash").scalar()
    meta = perturb.reference_metadata(frozen, digest, F.lit("2024-01-01T00:00:00"), "training_test_split")
    return meta.select(
        "num_samples", "num_features", "reference_hash", "source", F.array_join("features", ",").alias("features")
    )
