"""The replay query's gates on a recent promotion and on a segment that got worse."""

from pyspark.sql import functions as F

from modelwatch.catalog import governing, load, views

SF = "/root/testdata/sf0.01"


def failed_gate(spark):
    return load().QUERIES["replay_gate"](spark, SF).first()["failed_gate"]


def test_recent_promotion_fails_the_cooldown(spark, monkeypatch):
    recent = views.decisions(spark, SF).where("action = 'promote'").limit(1)
    recent = recent.withColumn("timestamp", F.lit(governing.AT).cast("timestamp_ntz") - F.expr("INTERVAL 2 DAYS"))
    monkeypatch.setattr(views, "decisions", lambda spark, sf: recent)
    assert failed_gate(spark) == "promotion_cooldown"


def test_worse_segment_fails_the_segment_gate(spark, monkeypatch):
    """One language's rows of the challenger are all wrong; it still gains over all rows."""
    rows = views.evaluated(spark, SF)
    small = rows.where("model = 'production'").groupBy("lang").count().where("count >= 30").orderBy("count", "lang").first()["lang"]
    wrong = (F.col("model") == "shadow") & (F.col("lang") == small)
    better = (F.col("model") == "shadow") & (F.col("lang") != small)
    truth = F.col("true_label")
    changed = rows.withColumns(
        {
            "prediction": F.when(wrong, 1 - truth).when(better, truth).otherwise(F.col("prediction")).cast(rows.schema["prediction"].dataType),
            "probability": F.when(better, truth.cast("double")).otherwise(F.col("probability")),
        }
    )
    monkeypatch.setattr(views, "evaluated", lambda spark, sf: changed)
    assert failed_gate(spark) == "no_segment_regression"
