"""Explicit schemas of the documents and tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

from buildlens.functions import rules

STEP = "struct<name:string,status:string,conclusion:string,number:int,started_at:string,finished_at:string,log_lines:array<string>>"


def webhook_schema(extension_field: str = "_extended") -> str:
    """Superset of the GitHub, GitLab and generic payloads with envelope and enrichment.

    ``extension_field`` is the vendor key under which a sender may add logs and steps.
    """
    return (
        "action string, object_kind string, build_id string, run_id string, "
        "workflow_run struct<id:string,name:string,head_branch:string,head_sha:string,status:string,"
        "conclusion:string,run_started_at:string,created_at:string,updated_at:string>, "
        "object_attributes struct<id:string,status:string,ref:string,sha:string,duration:double,"
        "created_at:string,updated_at:string>, "
        "repository string, project struct<id:string,path_with_namespace:string>, "
        "sender struct<login:string>, "
        "_meta struct<request_id:string,mongo_id:string,provider:string,signature_valid:boolean,"
        "received_at:string,source_ip:string,logs_fetched:boolean>, "
        "_enriched struct<build_id:string,repository:string,branch:string,commit_sha:string,status:string,"
        "conclusion:string,workflow_name:string,started_at:string,completed_at:string,"
        "duration_seconds:double,raw_logs:string,log_content:string,"
        f"steps:array<{STEP}>,log_files:array<struct<name:string,lines:int>>>, "
        f"`{extension_field}` struct<raw_logs:string,label:string,duration_seconds:double,"
        f"repository:string,branch:string,commit_sha:string,steps:array<{STEP}>>, "
        "jobs array<struct<name:string,steps:array<struct<name:string,status:string,"
        "conclusion:string,number:int>>>>"
    )


REPOSITORY = "full_name string, name string, owner struct<login:string>"

FEATURES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("build_id", "repo_name", "branch", "commit_sha")]
    + [
        T.StructField(
            c,
            T.DoubleType() if c in ("duration_seconds", "char_density", "template_entropy") else T.LongType(),
        )
        for c in rules.FEATURE_NAMES
    ]
    + [T.StructField("provider", T.StringType()), T.StructField("processed_at", T.StringType())]
)

REASON = "struct<feature:string,value:double,threshold:double,reason:string,severity:string>"
TOP_FEATURE = "struct<feature:string,value:double,z_score:double,deviation:string>"

RESULTS = (
    "build_id string, is_anomaly boolean, anomaly_score double, prediction int, confidence double, "
    f"anomaly_reasons array<{REASON}>, top_features array<{TOP_FEATURE}>, model_version string, "
    "raw_features string, created_at timestamp"
)
