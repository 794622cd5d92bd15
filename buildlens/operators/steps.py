"""Pipeline steps found in log texts, and the share of the log each one holds.

A step runs from its marker line to the next one.  Markers are found inside the
row of the build, so nothing is shuffled and no window has to hold a long log.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.numbers import round_to
from buildlens.functions import rules



def marker_name(line: Column) -> Column:
    """Name of the step a line opens, NULL for other lines."""
    names = [F.nullif(F.regexp_extract(line, "(?dU)" + p, 1), F.lit("")) for p in rules.STEP_MARKERS]
    return F.coalesce(*names)


def _markers(lines: Column) -> Column:
    """``(pos, name)`` of the marker lines, positions from 1."""
    named = F.transform(lines, lambda x, i: F.struct((i + 1).alias("pos"), marker_name(x).alias("name")))
    return F.filter(named, lambda m: m["name"].isNotNull())


def with_steps(logs: DataFrame, text: str = "raw_logs") -> DataFrame:
    """Add ``steps`` as array of ``(name, log_lines)``; without markers one step ``unknown``."""
    df = logs.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    df = df.withColumn("_markers", _markers(F.col("_lines")))
    ends = F.concat(F.slice(F.transform("_markers", lambda m: m["pos"]), 2, F.size("_markers")),
                    F.array(F.size("_lines") + 1))
    found = F.zip_with("_markers", ends, lambda m, e: F.struct(
        m["name"].alias("name"), F.slice("_lines", m["pos"], e - m["pos"]).alias("log_lines")))
    whole = F.array(F.struct(F.lit("unknown").alias("name"), F.col("_lines").alias("log_lines")))
    return df.withColumn("steps", F.when(F.size("_markers") > 0, found).otherwise(whole)).drop("_lines", "_markers")


def step_count(text: Column) -> Column:
    """Number of steps :func:`with_steps` finds, counted on the text itself."""
    marker = "|".join(f"(?:{p})" for p in rules.STEP_MARKERS)
    return F.greatest(F.regexp_count(text, F.lit("(?mdU)" + marker.replace(r"^\s*❯\s*", r"^[^\S\n]*❯[^\S\n]*"))), F.lit(1))


def all_step_lines(steps: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.flatten(F.transform(steps, lambda s: F.coalesce(s["log_lines"], none))), none)


def distribution_entries(steps: Column) -> Column:
    """``(name, lines)`` per step name: the last step of a name counts, no name is ``unknown``."""
    named = F.transform(steps, lambda s: F.struct(
        F.coalesce(s["name"], F.lit("unknown")).alias("name"),
        F.coalesce(F.size(s["log_lines"]), F.lit(0)).alias("lines")))
    names = F.transform(named, lambda s: s["name"])
    return F.filter(named, lambda s, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), s["name"]))


def event_distribution(steps: Column) -> Column:
    return F.map_from_entries(distribution_entries(steps))


def with_event_proportions(df: DataFrame, distribution: str = "event_distribution", digits: int = 6) -> DataFrame:
    """Add the shares of the standard steps in all step lines."""
    total = F.aggregate(F.map_values(distribution), F.lit(0), lambda a, x: a + x)
    total = F.when(total == 0, 1).otherwise(total)
    return df.withColumns({
        f"event_{s}": round_to(F.coalesce(F.try_element_at(F.col(distribution), F.lit(s)), F.lit(0)) / total, digits)
        for s in rules.STANDARD_STEPS
    })


def step_durations(builds: DataFrame) -> DataFrame:
    """One row per step with its seconds; ``total_log_lines`` of the build on each row."""
    from buildlens.functions.times import duration_iso

    lines = F.size(all_step_lines(F.col("steps")))
    return builds.withColumn("total_log_lines", lines).select(
        "build_id", "total_log_lines", F.posexplode("steps").alias("step_no", "step")
    ).select(
        "build_id", "step_no", F.col("step.name").alias("step_name"),
        round_to(duration_iso(F.col("step.started_at"), F.col("step.finished_at")), 6).alias("duration_seconds"),
        F.coalesce(F.size("step.log_lines"), F.lit(0)).alias("line_count"), "total_log_lines",
    )
