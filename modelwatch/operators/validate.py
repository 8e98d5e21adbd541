"""Data contracts: column rules counted in one pass, row rejection with reasons, keys and references."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.tables import ACTIONS, FEATURES, REAL_FEATURES, STAGES, TRIGGER_REASONS


@dataclass(frozen=True)
class Rule:
    """A named condition on a column; NULL counts as a violation unless ``nullable``."""

    name: str
    column: str
    condition: Column
    nullable: bool = False

    def violated(self) -> Column:
        missing = F.col(self.column).isNull()
        return F.when(missing, F.lit(not self.nullable)).otherwise(~F.coalesce(self.condition, F.lit(False)))


def between(column: str, low: float, high: float, nullable: bool = False) -> Rule:
    return Rule(f"{column} in [{low:g}, {high:g}]", column, F.col(column).between(low, high), nullable)


def at_least(column: str, low: float, nullable: bool = False) -> Rule:
    return Rule(f"{column} >= {low:g}", column, (F.col(column) >= low) & ~F.isnan(F.col(column).cast("double")), nullable)


def one_of(column: str, words: Sequence, nullable: bool = False) -> Rule:
    return Rule(f"{column} in ({', '.join(str(w) for w in words)})", column, F.col(column).isin(list(words)), nullable)


def present(column: str) -> Rule:
    return Rule(f"{column} not null", column, F.col(column).isNotNull())


def prediction_rules(features: Sequence[str] = FEATURES) -> list[Rule]:
    """Contract of the prediction table."""
    rules = [present(c) for c in ("timestamp", "prediction_id", "model_version")]
    rules += [one_of("prediction", [0, 1]), between("probability", 0, 1)]
    rules += [between(f, 18, 120) if f == "age" else at_least(f, 0) for f in features]
    return rules


def label_rules() -> list[Rule]:
    """Contract of the label table."""
    return [present(c) for c in ("prediction_id", "label_timestamp", "label_source")] + [one_of("true_label", [0, 1])]


def request_rules() -> list[Rule]:
    """Contract of a scoring request: required features, age 18-120, counts and income not negative."""
    free = ("RevolvingUtilizationOfUnsecuredLines", "DebtRatio")
    rules = [present(f) for f in free]
    rules += [between("age", 18, 120)]
    return rules + [at_least(f, 0) for f in FEATURES if f not in (*free, "age")]


def audit_rules() -> dict[str, list[Rule]]:
    """Allowed words per audit table."""
    return {
        "decisions": [one_of("trigger_reason", TRIGGER_REASONS), one_of("action", ACTIONS)],
        "versions": [one_of("stage", STAGES)],
    }


def schema_issues(df: DataFrame, expected: T.StructType) -> list[str]:
    """Missing columns and wrong types, from the schema alone (no job)."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    issues = []
    for f in expected.fields:
        if f.name not in actual:
            issues.append(f"missing column {f.name}")
        elif _kind(actual[f.name]) != _kind(f.dataType):
            issues.append(f"column {f.name} is {actual[f.name].simpleString()}, expected {f.dataType.simpleString()}")
    return issues


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, T.FractionalType):
        return "real"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return t.typeName()


def check_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule with its number of violations; all rules are counted in one pass."""
    counted = df.agg(*[F.count(F.when(r.violated(), True)).alias(f"r{i}") for i, r in enumerate(rules)])
    cells = [F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(rules)]
    return counted.select(F.inline(F.array(*cells)))


def check_unique(df: DataFrame, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """Number of keys that occur more than once, as a rule row."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name or f"unique ({', '.join(keys)})").alias("rule"), "violations"
    )


def check_reference(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """Number of child rows whose key has no parent, as a rule row. NULL keys are allowed."""
    parents = parent.select(F.col(parent_key).alias(child_key)).distinct()
    orphans = child.filter(F.col(child_key).isNotNull()).join(parents, child_key, "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def one_production_per_model(versions: DataFrame) -> DataFrame:
    """Governance rule: at most one version of a model is in Production."""
    return check_unique(versions.filter("stage = 'Production'"), ["model_name"], "one production version per model")


def contract_report(df: DataFrame, rules: Sequence[Rule], unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """All rule rows of a table, unique keys included."""
    out = check_rules(df, rules)
    for keys in unique:
        out = out.unionByName(check_unique(df, keys))
    return out


def split_rejects(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``reject_reasons``); a row filter, no shuffle."""
    tagged = with_reasons(df, rules)
    good = tagged.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    return good, tagged.filter(F.size("reject_reasons") > 0)


def with_reasons(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the names of the rules each row violates."""
    reasons = F.array_compact(F.array(*[F.when(r.violated(), r.name) for r in rules]))
    return df.withColumn("reject_reasons", reasons)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise before any job when columns are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_valid(report: DataFrame) -> None:
    """Raise when any rule row has violations. The report has one row per rule."""
    broken = {r["rule"]: r["violations"] for r in report.filter("violations > 0").collect()}
    if broken:
        raise ValueError(f"contract violated: {broken}")


def integer_features() -> list[str]:
    return [f for f in FEATURES if f not in REAL_FEATURES]
