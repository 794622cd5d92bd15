"""Webhook payloads to one common build record.

Input is a DataFrame with the columns of :func:`buildlens.schemas.webhook_schema`
(vendor key renamed to ``_extended``).  Every operator is a projection or a
filter over one delivery.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens import schemas
from buildlens.functions import times


def present(col: Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(col, F.lit(""))


def _has(prefix: str, fields: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"{prefix}.{f}").isNotNull() for f in fields])


def repository() -> Column:
    """Repository object; a plain ``owner/name`` text becomes its full name."""
    text = F.col("repository")
    return F.when(F.startswith(text, F.lit("{")), F.from_json(text, schemas.REPOSITORY)).when(
        text.isNotNull(),
        F.struct(text.alias("full_name"), F.get(F.split(text, "/"), F.lit(1)).alias("name"),
                 F.struct(F.get(F.split(text, "/"), F.lit(0)).alias("login")).alias("owner")))


def detect_provider() -> Column:
    meta = F.col("_meta.provider")
    return (
        F.when((meta == "github") | F.col("workflow_run").isNotNull(), "github")
        .when((meta == "gitlab") | F.col("object_attributes").isNotNull(), "gitlab")
        .otherwise("generic")
    )


def delivery_build_id(provider: Column) -> Column:
    """Identifier announced at ingestion."""
    return (
        F.when(provider == "github", F.coalesce(
            F.nullif(present(F.col("workflow_run.id")), F.lit("0")), F.col("action")))
        .when(provider == "gitlab", F.coalesce(
            F.nullif(present(F.col("object_attributes.id")), F.lit("0")), F.col("object_kind")))
        .otherwise(F.coalesce(present(F.col("build_id")), F.lit("unknown")))
    )


def metrics_build_id(provider: Column) -> Column:
    """Identifier used by the provider metrics, e.g. ``github-17``."""
    return F.when(provider == "github", F.concat(F.lit("github-"), F.col("workflow_run.id"))).when(
        provider == "gitlab", F.concat(F.lit("gitlab-"), F.col("object_attributes.id")))


_ENRICHMENT = ["raw_logs", "steps", "duration_seconds", "repository", "branch", "commit_sha"]


def _enrichment(field: str) -> Column:
    """Field of the enrichment, or of the vendor extension when there is no enrichment."""
    has = _has("_enriched", [*_ENRICHMENT, "log_content", "build_id", "status", "log_files"])
    return F.when(has, F.col(f"_enriched.{field}")).otherwise(F.col(f"_extended.{field}"))


def normalize_build(payloads: DataFrame, duration_mode: str = "strict") -> DataFrame:
    """``(build_id, repo_name, branch, commit_sha, duration_seconds, raw_logs, steps, provider)``,
    after ``delivery_id`` and ``received_at`` where the payloads have them.

    Values come from the payload, then from the enrichment or the vendor
    extension.  Job traces in ``log_content`` count as raw logs.
    ``duration_mode`` is ``strict`` (whole-second formats only) or ``iso``.
    """
    measure = {"strict": times.duration_strict, "iso": times.duration_iso}[duration_mode]
    kind = detect_provider()
    run, attrs = F.col("workflow_run"), F.col("object_attributes")
    gitlab = kind == "gitlab"
    request = F.coalesce(F.col("_meta.request_id"), F.lit("unknown"))
    timed = measure(F.coalesce(run["run_started_at"], F.lit("")), F.coalesce(run["updated_at"], F.lit("")))
    duration = F.when(gitlab, F.coalesce(attrs["duration"], F.lit(0.0))).otherwise(
        F.coalesce(F.nullif(_enrichment("duration_seconds"), F.lit(0.0)), timed))

    def value(run_value: Column, gitlab_value: Column, field: str) -> Column:
        return F.when(gitlab, F.coalesce(gitlab_value, F.lit(""))).otherwise(
            F.coalesce(present(run_value), _enrichment(field), F.lit("")))

    logs = F.coalesce(present(_enrichment("raw_logs")), F.col("_enriched.log_content"), F.lit(""))
    none = F.array().cast(f"array<{schemas.STEP}>")
    return payloads.withColumn("_repo", repository()).select(
        *[c for c in ("delivery_id", "received_at") if c in payloads.columns],
        F.when(gitlab, F.coalesce(attrs["id"], request)).otherwise(F.coalesce(run["id"], request)).alias("build_id"),
        value(F.col("_repo.full_name"), F.col("project.path_with_namespace"), "repository").alias("repo_name"),
        value(run["head_branch"], attrs["ref"], "branch").alias("branch"),
        value(run["head_sha"], attrs["sha"], "commit_sha").alias("commit_sha"),
        duration.alias("duration_seconds"),
        logs.alias("raw_logs"),
        F.coalesce(_enrichment("steps"), none).alias("steps"),
        F.when(kind != "generic", kind).otherwise(F.coalesce(F.col("_meta.provider"), F.lit("unknown"))).alias("provider"),
    )


def enrich_envelope(payloads: DataFrame, provider: Column, signature_valid: Column, received_at: Column,
                    source_ip: Column | None = None) -> DataFrame:
    """Replace ``_meta`` by a fresh envelope; ``logs_fetched`` says whether enrichment is there."""
    meta = F.struct(
        F.uuid().alias("request_id"),
        F.col("_meta.mongo_id").alias("mongo_id"),
        provider.alias("provider"),
        signature_valid.alias("signature_valid"),
        F.date_format(received_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("received_at"),
        (source_ip if source_ip is not None else F.lit(None).cast("string")).alias("source_ip"),
        F.col("_enriched").isNotNull().alias("logs_fetched"),
    )
    return payloads.withColumn("_meta", meta)


def filter_completed(payloads: DataFrame) -> DataFrame:
    """Finished runs: completed actions of completed runs, and ended pipelines."""
    run = (F.col("action") == "completed") & (F.col("workflow_run.status") == "completed")
    pipeline = F.col("object_attributes.status").isin("success", "failed", "canceled")
    return payloads.filter(F.coalesce(run, F.lit(False)) | F.coalesce(pipeline, F.lit(False)))


def split_repository(payloads: DataFrame) -> DataFrame:
    """Add ``owner``, ``repo`` and ``run``; the short form ``{repository, run_id}`` is expanded."""
    short = F.col("workflow_run").isNull() & F.col("run_id").isNotNull() & F.col("repository").isNotNull()
    run = F.when(short, F.struct(
        F.col("run_id").alias("id"), F.lit("Test Workflow").alias("name"), F.lit("main").alias("head_branch"),
        F.lit("test-sha").alias("head_sha"), F.lit("completed").alias("status"), F.lit("success").alias("conclusion"),
        F.lit(None).cast("string").alias("run_started_at"), F.lit(None).cast("string").alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"))).otherwise(F.col("workflow_run"))
    parts = F.split(F.col("_repo.full_name"), "/")
    owned = present(F.col("_repo.owner.login")).isNotNull()
    return (
        payloads.withColumn("_repo", repository())
        .withColumn("owner", F.when(owned, F.col("_repo.owner.login")).otherwise(F.get(parts, F.lit(0))))
        .withColumn("repo", F.when(owned, F.col("_repo.name")).otherwise(F.get(parts, F.lit(1))))
        .withColumn("action", F.when(short, F.lit("completed")).otherwise(F.col("action")))
        .withColumn("workflow_run", run)
        .drop("_repo")
    )


def job_step_counts(payloads: DataFrame) -> DataFrame:
    """Add step counters and flattened step details; jobs without steps count as jobs only."""
    jobs = F.coalesce(F.col("jobs"), F.array().cast(payloads.schema["jobs"].dataType))
    return (
        payloads.withColumn("step_details", F.flatten(F.transform(
            F.filter(jobs, lambda j: j["steps"].isNotNull()), lambda j: j["steps"])))
        .withColumn("job_count", F.size(jobs))
        .withColumn("step_count", F.size("step_details"))
        .withColumn("completed_steps", F.size(F.filter("step_details", lambda s: s["status"] == "completed")))
        .withColumn("failed_steps", F.size(F.filter("step_details", lambda s: s["conclusion"] == "failure")))
    )
