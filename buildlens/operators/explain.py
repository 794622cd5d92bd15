"""Confidence, security rules, reasons and feature contributions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.numbers import round_to
from buildlens import schemas
from buildlens.functions import rules


def confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - score))


def _reason(feature, value, threshold, reason, severity) -> Column:
    return F.struct(
        F.lit(feature).cast("string").alias("feature"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        F.lit(threshold).cast("double").alias("threshold"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        F.lit(severity).alias("severity"),
    )


def _amount(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def security_reasons() -> Column:
    """Critical reasons of the explicit rules; empty when none applies."""
    commands, ips, seconds = (_amount(c) for c in ("suspicious_pattern_count", "external_ip_count", "duration_seconds"))
    seen = commands >= 1
    text = {
        "commands": F.concat(F.lit("Detected "), commands.cast("string"),
                             F.lit(" suspicious command pattern(s) (e.g., xmrig, nc -e, curl|bash)")),
        "ips": F.concat(F.lit("Multiple external IP connections ("), ips.cast("string"),
                        F.lit(") with suspicious patterns")),
        "duration": F.concat(F.lit("Extended build duration ("), seconds.cast("string"),
                             F.lit("s) with suspicious patterns - possible cryptomining")),
    }
    return F.array_compact(F.array(
        F.when(seen, _reason("suspicious_pattern_count", commands, None, text["commands"], "critical")),
        F.when(seen & (ips >= 2), _reason("external_ip_count", ips, None, text["ips"], "critical")),
        F.when(seen & (seconds > 1200), _reason("duration_seconds", seconds, None, text["duration"], "critical")),
    ))


def rule_hit() -> Column:
    return _amount("suspicious_pattern_count") >= 1


def rule_override(df: DataFrame) -> DataFrame:
    """A rule makes the build an anomaly and a positive score slightly negative; the
    prediction of the model stays as it is."""
    hit = rule_hit()
    return df.withColumns({
        "is_anomaly": F.col("is_anomaly") | hit,
        "anomaly_score": F.when(hit & (F.col("anomaly_score") > 0), F.lit(-0.05)).otherwise(F.col("anomaly_score")),
    })


def threshold_reasons(is_anomaly: Column) -> Column:
    """Reasons by feature thresholds; NULL features are skipped."""
    candidates = []
    for name, high, very_high, reason in rules.FEATURE_THRESHOLDS:
        value = F.col(name).cast("double")
        candidates.append(F.when(value >= very_high, _reason(name, value, very_high, reason, "critical"))
                          .when(value >= high, _reason(name, value, high, reason, "warning")))
    found = F.array_compact(F.array(*candidates))
    normal = F.array(_reason(None, None, None, "Build metrics within normal parameters", "info"))
    generic = F.array(_reason(None, None, None, "Unusual combination of build metrics", "warning"))
    return F.when(~is_anomaly, normal).when(F.size(found) == 0, generic).otherwise(found)


def anomaly_reasons() -> Column:
    """Rule reasons first, then threshold reasons."""
    return F.concat(security_reasons(), threshold_reasons(F.col("is_anomaly")))


def contributions(means: dict[str, float], stds: dict[str, float], top: int = 5, digits: int = 2,
                  names: list[str] = rules.FEATURE_NAMES) -> Column:
    """Largest deviations from the training data: rounded |z|, ties in feature order."""
    if not means:
        return F.array().cast(f"array<{schemas.TOP_FEATURE}>")
    entries = []
    for i, name in enumerate(names):
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        std = stds.get(name, 1.0) or 0.0
        z = F.abs((value - F.lit(means.get(name, 0.0))) / F.lit(std)) if std > 0 else F.lit(0.0)
        entries.append(F.struct(
            (-round_to(z, digits)).alias("order"), F.lit(i).alias("idx"), F.lit(name).alias("feature"),
            value.alias("value"), round_to(z, digits).alias("z_score"),
            F.when(z > 2, "high").otherwise("normal").alias("deviation")))
    ordered = F.slice(F.sort_array(F.array(*entries)), 1, top)
    return F.transform(ordered, lambda e: F.struct(
        e["feature"].alias("feature"), e["value"].alias("value"), e["z_score"].alias("z_score"),
        e["deviation"].alias("deviation")))


def explain(scored: DataFrame, means: dict[str, float], stds: dict[str, float],
            model_version: str = rules.MODEL_VERSION) -> DataFrame:
    """Complete result rows from ``anomaly_score`` and ``prediction``."""
    first = scored.withColumn("confidence", confidence(F.col("anomaly_score"))) \
        .withColumn("is_anomaly", F.col("prediction") == -1)
    return rule_override(first).withColumn("anomaly_reasons", anomaly_reasons()) \
        .withColumn("top_features", contributions(means, stds)) \
        .withColumn("model_version", F.lit(model_version))
