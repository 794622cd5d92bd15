"""Per-build feature vectors, computed in one map-only pass over the log texts.

All inputs are one row per build.  A build's features depend on its own text
only, so the plans have no exchange: they scale with the number of input files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions import logtext as L
from buildlens.functions import rules
from buildlens.operators import steps as S


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def with_log_text(builds: DataFrame) -> DataFrame:
    """Add ``log_text``: the raw log, or the joined step lines when it has at most one line.

    A ``steps`` column is optional.  ``line_text`` keeps one line per step entry
    and is the same text unless an entry holds line breaks.
    """
    if "steps" not in builds.columns:
        text = F.when(L.has_many_lines(F.col("raw_logs")), F.col("raw_logs")).otherwise("")
        return builds.withColumn("log_text", text).withColumn("line_text", text)
    step_lines = F.flatten(F.transform(
        F.coalesce(F.col("steps"), F.array().cast(builds.schema["steps"].dataType)),
        lambda s: F.coalesce(s["log_lines"], F.array().cast("array<string>"))))
    many = L.has_many_lines(F.col("raw_logs"))
    return (
        builds.withColumn("log_text", F.when(many, F.col("raw_logs")).otherwise(F.array_join(step_lines, "\n")))
        .withColumn("line_text", F.when(many, F.col("raw_logs")).otherwise(L.step_lines_text(step_lines)))
    )


def template_measures(builds: DataFrame, text: str = "line_text") -> DataFrame:
    """Add ``unique_templates`` and ``template_entropy`` from simple line templates.

    The templates of a build are sorted inside its row and counted by runs, so
    no line leaves the task that read it.
    """
    return (
        builds.withColumn("_templates", L.simple_templates(F.col(text)))
        .withColumn("_ends", L.run_ends(F.col("_templates")))
        .drop("_templates")
        .withColumn("unique_templates", F.size("_ends").cast("bigint"))
        .withColumn("template_entropy", L.entropy_of_runs(F.col("_ends")))
        .drop("_ends")
    )


def log_measures(builds: DataFrame, trusted: list[str] = rules.TRUSTED_DOMAINS,
                 strict_dot: bool = False,
                 suspicious: list[str] = rules.SUSPICIOUS_PATTERNS) -> DataFrame:
    """Add the volume, keyword and security measures of ``log_text``/``line_text``."""
    text, line_text = F.col("log_text"), F.col("line_text")
    lowered = F.lower(text)
    lowered_lines = F.lower(line_text)
    return builds.withColumns({
        "log_line_count": L.nonblank_line_count(line_text).cast("bigint"),
        "char_density": L.char_density(line_text),
        "error_count": L.keyword_line_count(lowered_lines, rules.ERROR_KEYWORDS).cast("bigint"),
        "warning_count": L.keyword_line_count(lowered_lines, rules.WARNING_KEYWORDS).cast("bigint"),
        "suspicious_pattern_count": L.pattern_total(text, lowered, suspicious).cast("bigint"),
        "external_ip_count": L.external_ip_count(text).cast("bigint"),
        "external_url_count": L.external_url_count(text, trusted, strict_dot).cast("bigint"),
        "base64_pattern_count": L.base64_count(text, lowered).cast("bigint"),
    })


def build_features_12(builds: DataFrame, trusted: list[str] = rules.TRUSTED_DOMAINS,
                      strict_dot: bool = False,
                      suspicious: list[str] = rules.SUSPICIOUS_PATTERNS) -> DataFrame:
    """The 12 model features per build.

    Needs ``build_id``, ``raw_logs``; uses ``steps`` (array of structs with
    ``log_lines``) or ``step_count``, and ``duration_seconds`` when present.
    Other columns are carried along.
    """
    df = with_log_text(builds)
    if "step_count" not in df.columns:
        n = F.coalesce(F.size("steps"), F.lit(0)) if "steps" in df.columns else F.lit(0)
        df = df.withColumn("step_count", n.cast("bigint"))
    if "duration_seconds" not in df.columns:
        df = df.withColumn("duration_seconds", F.lit(0.0))
    df = template_measures(log_measures(df, trusted, strict_dot, suspicious))
    carried = [c for c in builds.columns if c not in ("raw_logs", "steps", *rules.FEATURE_NAMES)]
    return df.select(*carried, *[F.col(c) for c in rules.FEATURE_NAMES])


def build_features_mined(builds: DataFrame, mined: DataFrame, key: str = "build_id") -> DataFrame:
    """The 12 features with the two template features taken from ``mined`` measures (``mining.mined_measures``).

    A build without a line with tokens has no template: 0 and 0.
    """
    measures = mined.select(F.col(key), F.col("unique_templates").alias("_u"), F.col("template_entropy").alias("_e"))
    joined = build_features_12(builds).join(measures, key, "left")
    return joined.withColumn("unique_templates", F.coalesce("_u", F.lit(0)).cast("bigint")) \
        .withColumn("template_entropy", F.coalesce("_e", F.lit(0.0))).drop("_u", "_e")


def feature_vector(names: list[str] = rules.FEATURE_NAMES) -> Column:
    """Ordered vector; a missing value counts as 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])


def _strict_measures(builds: DataFrame) -> DataFrame:
    text = F.col("raw_logs")
    lowered = F.lower(text)
    return builds.withColumns({
        "log_line_count": L.raw_line_count(text).cast("bigint"),
        "char_density": L.raw_char_density(text),
        "error_count": L.keyword_line_count(lowered, rules.ERROR_KEYWORDS).cast("bigint"),
        "warning_count": L.keyword_line_count(lowered, rules.WARNING_KEYWORDS).cast("bigint"),
        "unique_ips_contacted": L.external_ip_count_strict(text).cast("bigint"),
        "external_urls_count": F.size(L.untrusted_hosts(text, rules.TRUSTED_DOMAINS_STRICT)).cast("bigint"),
        "base64_patterns": L.base64_strict_count(text).cast("bigint"),
        "suspicious_commands": L.pattern_total(text, lowered, rules.SUSPICIOUS_COMMANDS_STRICT).cast("bigint"),
    })


def build_features_16(builds: DataFrame) -> DataFrame:
    """Core features, shares of the six standard steps and strict security counts.

    Needs ``raw_logs`` and ``steps`` (``name``, ``log_lines``).
    """
    df = builds.withColumn("raw_logs", _or_empty("raw_logs"))
    df = df.withColumn("step_count", F.size("steps").cast("bigint")) \
        .withColumn("event_distribution", S.event_distribution(F.col("steps")))
    if "duration_seconds" not in df.columns:
        df = df.withColumn("duration_seconds", F.lit(0.0))
    df = S.with_event_proportions(_strict_measures(df))
    carried = [c for c in builds.columns if c not in ("raw_logs", "steps", *rules.FEATURE_NAMES_16)]
    return df.select(*carried, "event_distribution", *[F.col(c) for c in rules.FEATURE_NAMES_16])


def features_from_raw_text(logs: DataFrame, started: str | None = None, finished: str | None = None) -> DataFrame:
    """Features from bare text and optional times: steps are found in the text, and the
    templates are the ones with hex runs of 7 or more, cut at 100 characters, over all lines.
    """
    seconds = F.lit(0.0)
    if started and finished:
        micros = F.unix_micros(F.col(finished).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))
        seconds = F.coalesce(micros / F.lit(1e6), F.lit(0.0))
    df = logs.withColumn("raw_logs", _or_empty("raw_logs")).withColumn("duration_seconds", seconds)
    df = _strict_measures(df).withColumn("step_count", S.step_count(F.col("raw_logs")).cast("bigint"))
    cut = F.transform(F.split(L.simple_template(F.col("raw_logs"), 7), "\n", -1),
                      lambda x: F.substring(x, 1, 100))
    df = (
        df.withColumn("_templates", F.sort_array(cut))
        .withColumn("_ends", L.run_ends(F.col("_templates")))
        .withColumn("unique_templates", F.size("_ends").cast("bigint"))
        .withColumn("template_entropy", L.entropy_of_runs(F.col("_ends")))
        .withColumn("suspicious_pattern_count", F.col("suspicious_commands"))
        .withColumn("external_ip_count", F.col("unique_ips_contacted"))
        .withColumn("external_url_count", F.col("external_urls_count"))
        .withColumn("base64_pattern_count", F.col("base64_patterns"))
    )
    carried = [c for c in logs.columns if c not in ("raw_logs", *rules.FEATURE_NAMES)]
    return df.select(*carried, *[F.col(c) for c in rules.FEATURE_NAMES])


def generated_features(builds: DataFrame) -> DataFrame:
    """The labelled-generator variant: all lines of the steps, per-line security counts."""
    text = F.col("log_text")
    df = (
        builds.withColumn("log_text", F.array_join(S.all_step_lines(F.col("steps")), "\n"))
        .withColumn("_lines", S.all_step_lines(F.col("steps")))
    )
    return df.withColumns({
        "suspicious_pattern_count": L.line_pattern_total(F.col("_lines"), rules.SUSPICIOUS_LINE_PATTERNS),
        "external_ip_count": L.external_ip_count_octets(text),
        "external_url_count": F.size(F.array_distinct(
            L.untrusted_hosts(text, rules.TRUSTED_DOMAINS_GENERATED))),
        "base64_pattern_count": L.base64_line_count(text),
    }).drop("_lines", "log_text")
