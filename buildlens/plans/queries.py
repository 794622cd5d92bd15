"""One runnable query per operator over the driver tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.numbers import round_to
from buildlens.functions import logtext as L
from buildlens.functions import rules, signature, times
from buildlens.operators import evaluate as E
from buildlens.operators import explain as X
from buildlens.operators import features as B
from buildlens.operators import forest as M
from buildlens.operators import mining as D
from buildlens.operators import neighbors as K
from buildlens.operators import normalize as N
from buildlens.operators import prep as P
from buildlens.operators import serving as G
from buildlens.operators import steps as S
from buildlens.plans.views import WEBHOOK_SECRET, view
from buildlens.sources import feature_tables as T
from buildlens.sources import webhooks as H
from buildlens.sources.storage import append_by_period, materialize, new_folder
from buildlens.streaming import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AS_OF_COLUMN = "created_at"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = H.quarantine(view(spark, sf, "deliveries"))
    return H.parse_bodies(good)


def _builds(spark: SparkSession, sf: str) -> DataFrame:
    return N.normalize_build(_payloads(spark, sf))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "all_logs")


def _days(n: float) -> int:
    return int(n * 24)


# ------------------------------------------------------------ sources and sinks

@query
def src_webhooks(spark, sf):
    path = new_folder(spark, "webhooks")
    view(spark, sf, "deliveries").select("body").write.text(path)
    docs = H.read_webhooks(spark, path, multi_line=False)
    return docs.select(
        F.col("_corrupt_record").isNotNull().alias("corrupt"), "action",
        F.coalesce("workflow_run.id", "object_attributes.id", "build_id", "run_id").alias("id"),
        F.coalesce(N.repository()["full_name"], F.col("project.path_with_namespace")).alias("full_name"),
        F.col("workflow_run.run_started_at").alias("started"),
        F.char_length(F.coalesce("_enriched.raw_logs", "_enriched.log_content")).alias("log_chars"),
        F.size(F.coalesce("_enriched.steps", "_extended.steps")).alias("steps"))


@query
def sink_raw_logs(spark, sf):
    path = new_folder(spark, "raw-logs")
    d = view(spark, sf, "deliveries")
    rows = H.raw_log_rows(d, F.col("provider"), F.col("body"), F.col("delivery_id") % 3 != 0, F.col("received_at"))
    H.write_raw_logs(rows, path)
    return spark.read.parquet(path).select("delivery_id", "source", "payload", "signature_valid", "received_at", "processed")


@query
def src_training_csv(spark, sf):
    path = new_folder(spark, "training")
    T.write_feature_csv(view(spark, sf, "feature_rows").drop("created_at"), path)
    return T.read_training_csv(spark, path).select("build_id", *rules.FEATURE_NAMES, "label")


@query
def sink_feature_csv(spark, sf):
    path = new_folder(spark, "features-csv")
    rows = view(spark, sf, "feature_rows").drop("created_at")
    T.write_feature_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query
def sink_feature_msgs(spark, sf):
    path = new_folder(spark, "messages")
    rows = view(spark, sf, "feature_rows")
    T.feature_messages(rows, F.concat(F.lit("r-"), F.col("build_id")), F.lit(None).cast("string"),
                       F.lit("2024-01-01T00:00:00Z")).write.parquet(path)
    m = F.from_json("value", T.message_schema())
    return spark.read.parquet(path).select("key", m.alias("m")).select(
        "key", F.col("m._meta.request_id").alias("request_id"), F.col("m._meta.source").alias("source"),
        F.col("m.features.log_line_count").alias("log_line_count"), F.col("m.features.duration_seconds").alias("duration_seconds"),
        round_to(F.aggregate("m.feature_vector", F.lit(0.0), lambda a, x: a + x), 4).alias("vector_sum"),
        F.size("m.feature_vector").alias("vector_size"), F.array_join("m.feature_names", ",").alias("names"))


@query
def src_feature_msgs(spark, sf):
    good, _ = H.quarantine(view(spark, sf, "feature_messages"), "value")
    return T.decode_feature_messages(good).select("event_id", "build_id", "duration_seconds", "log_line_count", "error_count")


@query
def quarantine_bad_msgs(spark, sf):
    good, bad = H.quarantine(view(spark, sf, "deliveries"))
    return good.select("delivery_id", F.lit("ok").alias("status")).unionByName(
        bad.select("delivery_id", F.col("reason").alias("status")))


@query
def sink_build_metrics(spark, sf):
    path = new_folder(spark, "build-metrics")
    append_by_period(T.build_metric_rows(view(spark, sf, "feature_rows"), F.col("created_at")), path, period="month")
    event = F.from_json("event_distribution", "unique_templates long, template_entropy double, "
                        "suspicious_patterns long, external_ips long, external_urls long")
    return spark.read.parquet(path).withColumn("e", event).select(
        "build_id", "duration_seconds", "log_line_count", "char_density", "error_count", "warning_count", "e.*",
        F.date_format("month", "yyyy-MM-dd").alias("month"))


@query
def sink_anomaly_results(spark, sf):
    path = new_folder(spark, "results")
    scored = view(spark, sf, "scored_rows")
    stats = {n: (float(i), float(i + 1)) for i, n in enumerate(rules.FEATURE_NAMES)}
    results = X.explain(scored, {n: v[0] for n, v in stats.items()}, {n: v[1] for n, v in stats.items()})
    append_by_period(T.result_rows(results.drop("model_version"), F.col("created_at")), path, period="month")
    return spark.read.parquet(path).select(
        "build_id", "is_anomaly", round_to("anomaly_score", 6).alias("anomaly_score"), "prediction",
        round_to("confidence", 6).alias("confidence"), "model_version",
        F.get_json_object("anomaly_reasons", "$[0].reason").alias("first_reason"),
        F.get_json_object("anomaly_reasons", "$[0].severity").alias("first_severity"),
        F.size(F.from_json("anomaly_reasons", "array<struct<severity:string>>")).alias("n_reasons"),
        F.size(F.from_json("top_features", "array<struct<feature:string>>")).alias("n_top"),
        F.get_json_object("raw_features", "$.log_line_count").cast("long").alias("raw_lines"))


@query
def sink_parsed_logs(spark, sf):
    path = new_folder(spark, "parsed-logs")
    D.parsed_logs(D.simple_lines(_texts(spark, sf))).withColumn("parsed_at", F.current_timestamp()).write.parquet(path)
    return spark.read.parquet(path).select(
        "raw_log_id", F.array_join("event_ids", ",").alias("event_ids"), F.size("templates").alias("n_templates"),
        F.aggregate("templates", F.lit(0).cast("long"), lambda a, t: a + t["count"]).alias("n_lines"))


@query
def assemble_log_files(spark, sf):
    files = view(spark, sf, "log_files")
    runs = H.assemble_log_files(files).select("run_id", "raw_logs", "file_count", "total_lines",
                                              F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["name"], f["lines"].cast("string"))), ",").alias("files"))
    return runs.join(H.assemble_job_traces(files), "run_id")


@query
def model_save_load(spark, sf):
    rows = materialize(view(spark, sf, "feature_rows"), "rows")
    path = new_folder(spark, "model")
    M.save_model(spark, M.train(rows.filter("label = 'normal'"), trained_at="2024-01-31T00:00:00"), path)
    return M.load_model(spark, path).score(rows).select("build_id", round_to("anomaly_score", 6).alias("anomaly_score"), "prediction")


# --------------------------------------------------------------- normalisation

@query
def detect_provider(spark, sf):
    p = _payloads(spark, sf)
    return p.select("delivery_id", N.detect_provider().alias("provider_kind"),
                    signature.signature_provider(F.when(F.col("provider") == "github", "sha256=x"),
                                                 F.when(F.col("provider") == "gitlab", "t")).alias("header_provider"))


@query
def extract_build_id(spark, sf):
    kind = N.detect_provider()
    return _payloads(spark, sf).select("delivery_id", N.delivery_build_id(kind).alias("build_id"),
                                       N.metrics_build_id(kind).alias("metrics_id"))


@query
def normalize_build(spark, sf):
    return _builds(spark, sf).select("delivery_id", "build_id", "repo_name", "branch", "commit_sha", "duration_seconds",
                                     F.md5("raw_logs").alias("logs_md5"), F.size("steps").alias("n_steps"), "provider")


@query
def enrich_envelope(spark, sf):
    p = N.enrich_envelope(_payloads(spark, sf), F.col("provider"), F.col("delivery_id") % 3 != 0, F.col("received_at"))
    return p.select("delivery_id", F.col("_meta.provider").alias("provider"), F.col("_meta.signature_valid").alias("signature_valid"),
                    F.col("_meta.logs_fetched").alias("logs_fetched"), F.char_length("_meta.request_id").alias("id_length"),
                    F.substring("_meta.received_at", 1, 19).alias("received_at"))


@query
def filter_completed(spark, sf):
    return N.filter_completed(_payloads(spark, sf)).select("delivery_id", "action")


@query
def split_repo(spark, sf):
    return N.split_repository(_payloads(spark, sf)).select(
        "delivery_id", "owner", "repo", F.col("workflow_run.id").alias("run_id"), F.col("workflow_run.head_branch").alias("head_branch"), "action")


def _signed(spark, sf):
    """Deliveries with the headers a sender would add; every third one is signed wrongly."""
    wrong = F.col("delivery_id") % 3 == 0
    return view(spark, sf, "deliveries").withColumns({
        "hub_signature": F.when(F.col("provider") == "github", F.when(wrong, F.lit("sha256=00")).otherwise(
            F.concat(F.lit("sha256="), signature.hmac_sha256(F.col("body"), WEBHOOK_SECRET)))),
        "gitlab_token": F.when(F.col("provider") == "gitlab", F.when(wrong, "other").otherwise(WEBHOOK_SECRET)),
    })


@query
def signature_audit(spark, sf):
    d = _signed(spark, sf)
    args = (F.col("body"), F.col("hub_signature"), F.col("gitlab_token"), WEBHOOK_SECRET)
    return d.select("delivery_id", "hub_signature", signature.signature_valid(*args).alias("valid"),
                    signature.signature_valid(*args, development=True).alias("valid_in_development"))


@query
def duration_strict(spark, sf):
    return view(spark, sf, "run_times").select("event_id", times.duration_strict(F.col("started"), F.col("finished")).alias("seconds"))


@query
def duration_iso(spark, sf):
    return view(spark, sf, "run_times").select("event_id", round_to(times.duration_iso(F.col("started"), F.col("finished")), 6).alias("seconds"))


@query
def duration_fallback(spark, sf):
    t = view(spark, sf, "run_times")
    run = times.duration_run(F.col("started"), F.col("created"), F.col("finished"))
    return t.select("event_id", run.alias("run_seconds"),
                    times.duration_pipeline(F.col("reported"), F.col("created"), F.col("finished")).alias("pipeline_seconds"),
                    F.coalesce(F.nullif(F.col("reported"), F.lit(0.0)), run.cast("double")).alias("build_seconds"))


@query
def job_step_counts(spark, sf):
    p = N.job_step_counts(_payloads(spark, sf))
    return p.select("delivery_id", "job_count", "step_count", "completed_steps", "failed_steps",
                    F.array_join(F.transform("step_details", lambda s: F.concat(s["name"], F.lit("/"), s["number"].cast("string"))), ",").alias("steps"))


@query
def step_durations(spark, sf):
    return S.step_durations(_builds(spark, sf))


# -------------------------------------------------------------------- log text

@query
def log_lines(spark, sf):
    lines = L.log_lines(F.col("raw_logs"), S.all_step_lines(F.col("steps")))
    return _builds(spark, sf).select("delivery_id", F.posexplode(lines).alias("line_no", "line"))


@query
def line_volume(spark, sf):
    return B.with_log_text(_texts(spark, sf)).select(
        "build_id", L.nonblank_line_count(F.col("log_text")).cast("bigint").alias("log_line_count"),
        L.char_density(F.col("log_text")).alias("char_density"))


@query
def line_volume_raw(spark, sf):
    return _texts(spark, sf).select(
        "build_id", L.raw_line_count(F.col("raw_logs")).cast("bigint").alias("lines"),
        L.raw_line_count(F.col("raw_logs"), 1).cast("bigint").alias("trace_lines"),
        L.raw_char_density(F.col("raw_logs")).alias("char_density"))


@query
def keyword_line_counts(spark, sf):
    low = F.lower("raw_logs")
    return _texts(spark, sf).select(
        "build_id", L.keyword_line_count(low, rules.ERROR_KEYWORDS).alias("error_count"),
        L.keyword_line_count(low, rules.WARNING_KEYWORDS).alias("warning_count"))


@query
def keyword_token_counts(spark, sf):
    return _texts(spark, sf).select(
        "build_id", L.keyword_token_count(F.col("raw_logs"), rules.ERROR_KEYWORDS).alias("error_count"),
        L.keyword_token_count(F.col("raw_logs"), rules.WARNING_KEYWORDS).alias("warning_count"))


@query
def keyword_line_regex(spark, sf):
    low = F.lower("raw_logs")
    return _texts(spark, sf).select(
        "build_id", L.keyword_line_count(low, rules.JOB_ERROR_KEYWORDS).alias("error_count"),
        L.keyword_line_count(low, rules.JOB_WARNING_KEYWORDS).alias("warning_count"),
        L.keyword_line_count(low, rules.GENERATED_WARNING_KEYWORDS).alias("generated_warning_count"))


@query
def suspicious_count(spark, sf):
    return _texts(spark, sf).select("build_id", L.pattern_total(
        F.col("raw_logs"), F.lower("raw_logs"), rules.SUSPICIOUS_PATTERNS).alias("suspicious_pattern_count"))


@query
def suspicious_count_strict(spark, sf):
    return _texts(spark, sf).select(
        "build_id", L.pattern_total(F.col("raw_logs"), F.lower("raw_logs"), rules.SUSPICIOUS_COMMANDS_STRICT).alias("suspicious_commands"),
        L.line_pattern_total(L.lines(F.col("raw_logs")), rules.SUSPICIOUS_LINE_PATTERNS).alias("suspicious_lines"))


@query
def external_ip_count(spark, sf):
    return _texts(spark, sf).select("build_id", L.external_ip_count(F.col("raw_logs")).alias("external_ip_count"))


@query
def external_ip_count_strict(spark, sf):
    return _texts(spark, sf).select("build_id", L.external_ip_count_strict(F.col("raw_logs")).alias("unique_ips_contacted"),
                                    L.external_ip_count_octets(F.col("raw_logs")).alias("external_ips"))


@query
def external_url_count(spark, sf):
    return view(spark, sf, "url_texts").select(
        "build_id", L.external_url_count(F.col("raw_logs")).alias("external_url_count"),
        L.external_url_count(F.col("raw_logs"), strict_dot=True).alias("external_url_count_strict_dot"))


@query
def external_url_variants(spark, sf):
    text = F.col("raw_logs")
    return view(spark, sf, "url_texts").select(
        "build_id", F.size(L.untrusted_hosts(text, rules.TRUSTED_DOMAINS_STRICT)).alias("external_urls_count"),
        F.size(F.array_distinct(L.untrusted_hosts(text, rules.TRUSTED_DOMAINS_GENERATED))).alias("external_hosts"))


def _url_rows(spark, sf):
    rows = view(spark, sf, "url_texts").select("build_id", F.posexplode(L.urls(F.col("raw_logs"))).alias("url_no", "url"))
    return rows.withColumn("domain", L.url_domain(F.col("url")))


@query
def url_trust_split(spark, sf):
    return _url_rows(spark, sf).withColumn("is_trusted", L.is_trusted(F.col("domain")))


@query
def top_untrusted_domains(spark, sf):
    # Counted first, judged once per distinct domain.
    return _url_rows(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).filter(~L.is_trusted(F.col("domain"))) \
        .orderBy(F.desc("n"), "domain").limit(10)


def untrusted_url_alert_rows(texts: DataFrame, threshold: int = 100) -> DataFrame:
    """Builds with more untrusted URLs than the threshold, with ten of their domains."""
    found = texts.withColumn("_d", L.untrusted_domains(F.col("raw_logs")))
    return found.filter(F.size("_d") > threshold).select(
        "build_id", F.size("_d").alias("untrusted_urls"),
        F.array_join(F.slice(F.array_sort(F.array_distinct("_d")), 1, 10), ",").alias("sample_domains"))


@query
def untrusted_url_alert(spark, sf):
    return untrusted_url_alert_rows(view(spark, sf, "url_texts"), 6)


@query
def base64_count(spark, sf):
    return _texts(spark, sf).select("build_id", L.base64_count(F.col("raw_logs"), F.lower("raw_logs")).alias("base64_pattern_count"))


@query
def base64_count_variants(spark, sf):
    return _texts(spark, sf).select("build_id", L.base64_strict_count(F.col("raw_logs")).alias("base64_patterns"),
                                    L.base64_line_count(F.col("raw_logs")).alias("base64_lines"))


# ------------------------------------------------------------------- templates

@query
def mask_variables(spark, sf):
    masked = F.split(L.mask_variables(F.col("raw_logs")), "\n", -1)
    return _texts(spark, sf).select("build_id", F.posexplode(masked).alias("line_no", "masked"))


def _lines(spark, sf):
    return _texts(spark, sf).select("build_id", F.posexplode(F.split("raw_logs", "\n", -1)).alias("line_no", "line"))


@query
def tokenize_line(spark, sf):
    tokens = L.tokenize(F.col("line"))
    return _lines(spark, sf).select("build_id", "line_no", F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


@query
def simple_template(spark, sf):
    line = F.col("line")
    return _lines(spark, sf).select("build_id", "line_no", L.strip(L.simple_template(line)).alias("template"),
                                    F.substring(L.simple_template(line, 7), 1, 100).alias("short_template"))


@query
def template_id(spark, sf):
    return _lines(spark, sf).select("build_id", "line_no", L.template_id(L.tokenize(F.col("line"))).alias("template_id"))


def _mined(spark, sf):
    lines = materialize(D.masked_lines(_texts(spark, sf)), "lines")
    return (lines, *D.mine_templates(lines))


@query
def mine_templates(spark, sf):
    templates, _ = D.mine_templates(D.masked_lines(_texts(spark, sf)))
    return templates.select("template_id", "template", "n")


@query
def mine_templates_exact(spark, sf):
    """Templates of the search tree with shared branches, from the build logs."""
    templates, _ = D.mine_templates(D.masked_lines(view(spark, sf, "build_logs")), exact=True)
    return templates.select("template_id", "template", "n")


@query
def assign_templates(spark, sf):
    lines, _, assignment = _mined(spark, sf)
    return D.assign_templates(lines, assignment).select("build_id", "line_no", "raw", "template_id", "template", "tokens")


@query
def template_distribution(spark, sf):
    return D.template_distribution(D.simple_lines(_texts(spark, sf)))


@query
def recent_templates(spark, sf):
    seen = D.simple_lines(_texts(spark, sf)).groupBy("template_id", "template").agg(
        F.min(F.struct("build_id", "line_no")).alias("seen"), F.count(F.lit(1)).alias("n"))
    return D.recent_templates(seen).select("template_id", "template", "n")


@query
def unique_templates(spark, sf):
    return B.template_measures(_texts(spark, sf), "raw_logs").select("build_id", "unique_templates")


@query
def template_entropy(spark, sf):
    return B.template_measures(_texts(spark, sf), "raw_logs").select("build_id", "template_entropy")


@query
def detect_steps(spark, sf):
    steps = S.with_steps(view(spark, sf, "marked_logs"))
    return steps.select("build_id", F.posexplode("steps").alias("step_no", "s")).select(
        "build_id", "step_no", F.col("s.name").alias("name"), F.size("s.log_lines").alias("line_count"),
        F.md5(F.array_join("s.log_lines", "\n")).alias("lines_md5"))


@query
def event_distribution(spark, sf):
    steps = S.with_steps(view(spark, sf, "marked_logs"))
    return steps.select("build_id", F.explode(S.distribution_entries(F.col("steps"))).alias("e")).select("build_id", "e.name", "e.lines")


@query
def event_proportions(spark, sf):
    steps = S.with_steps(view(spark, sf, "marked_logs")).withColumn("event_distribution", S.event_distribution(F.col("steps")))
    return S.with_event_proportions(steps).select("build_id", *[f"event_{s}" for s in rules.STANDARD_STEPS])


@query
def build_features_12(spark, sf):
    return B.build_features_12(_texts(spark, sf)).select("build_id", "repo_name", *rules.FEATURE_NAMES)


@query
def build_features_mined(spark, sf):
    """The 12 features over mined templates instead of simple ones."""
    builds = view(spark, sf, "build_logs").select("build_id", "repo_name", "raw_logs", "duration_seconds", "step_count")
    lines = materialize(D.masked_lines(B.with_log_text(builds), "line_text").select("build_id", "line_no", "seq"), "lines")
    _, assignment = D.mine_templates(lines)
    return B.build_features_mined(builds, D.mined_measures(lines, assignment)).select("build_id", "repo_name", *rules.FEATURE_NAMES)


@query
def build_features_16(spark, sf):
    return B.build_features_16(S.with_steps(view(spark, sf, "step_logs"))).select("build_id", *rules.FEATURE_NAMES_16)


@query
def features_from_raw_text(spark, sf):
    return B.features_from_raw_text(view(spark, sf, "step_logs"), "created_at", "finished_at").select("build_id", *rules.FEATURE_NAMES)


# ----------------------------------------------------------------------- joins

def _with_reasons(results):
    reason = F.concat(F.lit('[{"reason":"result '), F.col("id").cast("string"), F.lit('","severity":"warning"}]'))
    return results.withColumn("anomaly_reasons", F.when(F.col("is_anomaly"), reason))


@query
def recent_builds_status(spark, sf):
    metrics = view(spark, sf, "build_logs").select(
        "build_id", "repo_name", "branch", "duration_seconds", "log_line_count", "error_count", "created_at")
    return G.recent_builds_status(metrics, _with_reasons(view(spark, sf, "build_results")))


@query
def mark_processed(spark, sf):
    path = new_folder(spark, "raw-logs")
    d = view(spark, sf, "deliveries")
    H.write_raw_logs(H.raw_log_rows(d, F.col("provider"), F.col("body"), F.lit(True), F.col("received_at")), path)
    parsed = _builds(spark, sf).select("delivery_id", "received_at")
    G.mark_processed_table(spark, path, parsed, F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz"))
    return spark.read.parquet(path).select("delivery_id", "source", "processed", "processed_at")


@query
def trusted_suffix_join(spark, sf):
    trusted = spark.createDataFrame([(t,) for t in rules.TRUSTED_DOMAINS], "suffix string")
    return G.trusted_suffix_join(_url_rows(spark, sf).select("build_id", "url_no", "domain"), trusted)


@query
def template_lookup_join(spark, sf):
    # The dictionary was mined on the documents; build logs read it as a stream would.
    mined = materialize(D.masked_lines(view(spark, sf, "doc_logs")).drop("raw"), "lines")
    _, assignment = D.mine_templates(mined)
    # Documents and build logs are all logs; the lines of the documents are masked already.
    lines = mined.unionByName(D.masked_lines(view(spark, sf, "build_logs")).drop("raw"))
    return D.assign_templates(lines, assignment).select("build_id", "line_no", "template_id", "template")


# ----------------------------------------------------------------------- model

@query
def align_features(spark, sf):
    return P.alignment_report(view(spark, sf, "feature_rows_missing"))


@query
def impute_median(spark, sf):
    rows = materialize(view(spark, sf, "feature_rows_gaps").select("build_id", *rules.FEATURE_NAMES), "rows")
    return P.impute_median(rows, rules.FEATURE_NAMES).select(
        "build_id", *[round_to(n, 6).alias(n) for n in rules.FEATURE_NAMES])


@query
def standard_scale(spark, sf):
    rows = materialize(view(spark, sf, "feature_rows").select("build_id", *rules.FEATURE_NAMES), "rows")
    return P.fit_scaler(rows).transform(rows, 6).select("build_id", *rules.FEATURE_NAMES)


@query
def feature_vector(spark, sf):
    return view(spark, sf, "feature_rows_gaps").select("build_id", F.posexplode(B.feature_vector()).alias("position", "value"))


@query
def iforest_fit(spark, sf):
    rows = materialize(view(spark, sf, "feature_rows").select("build_id", *rules.FEATURE_NAMES), "rows")
    drawn = M.draw_samples(rows, rules.FEATURE_NAMES, "build_id", rows.count(), rules.N_ESTIMATORS, rules.MAX_SAMPLES, rules.RANDOM_STATE)
    return M.grow_trees(drawn, rules.FEATURE_NAMES, 8, rules.RANDOM_STATE)


def _trained(spark, sf):
    rows = materialize(view(spark, sf, "feature_rows"), "rows")
    return rows, M.train(rows.filter("label = 'normal'"))


@query
def iforest_score(spark, sf):
    rows, model = _trained(spark, sf)
    return model.score(rows).select("build_id", round_to("anomaly_score", 6).alias("anomaly_score"), "prediction")


@query
def training_stats(spark, sf):
    stats = P.training_stats(view(spark, sf, "scored_rows"))
    return stats.select("n_samples", "n_features", "n_anomalies_detected", *[
        round_to(c, 4).alias(c) for c in ("anomaly_ratio", "score_mean", "score_std",
                                         *[f"mean_{n}" for n in rules.FEATURE_NAMES], *[f"std_{n}" for n in rules.FEATURE_NAMES])])


@query
def confidence(spark, sf):
    return view(spark, sf, "scored_rows").select("build_id", round_to(X.confidence(F.col("anomaly_score")), 6).alias("confidence"))


@query
def security_rules(spark, sf):
    return view(spark, sf, "scored_rows").select("build_id", F.posexplode(X.security_reasons()).alias("position", "r")).select(
        "build_id", "position", "r.feature", round_to("r.value", 4).alias("value"), "r.severity", "r.reason")


@query
def rule_override(spark, sf):
    first = view(spark, sf, "scored_rows").withColumn("is_anomaly", F.col("prediction") == -1)
    return X.rule_override(first).select("build_id", "is_anomaly", round_to("anomaly_score", 6).alias("anomaly_score"), "prediction")


@query
def threshold_reasons(spark, sf):
    first = view(spark, sf, "scored_rows").withColumn("is_anomaly", F.col("prediction") == -1)
    return first.select("build_id", F.posexplode(X.threshold_reasons(F.col("is_anomaly"))).alias("position", "r")).select(
        "build_id", "position", "r.feature", "r.threshold", "r.reason", "r.severity")


@query
def top_contributions(spark, sf):
    rows = materialize(view(spark, sf, "scored_rows"), "rows")
    stats = P.training_stats(rows).first().asDict()
    means = {n: round(stats[f"mean_{n}"], 4) for n in rules.FEATURE_NAMES}
    stds = {n: round(stats[f"std_{n}"], 4) for n in rules.FEATURE_NAMES}
    return rows.select("build_id", F.posexplode(X.contributions(means, stds)).alias("position", "c")).select(
        "build_id", "position", "c.feature", "c.z_score", "c.deviation")


@query
def predict_batch(spark, sf):
    rows, model = _trained(spark, sf)
    results = M.predict(rows, model)
    return results.select("build_id", "is_anomaly", round_to("anomaly_score", 6).alias("anomaly_score"), "prediction",
                          round_to("confidence", 6).alias("confidence"), F.to_json("anomaly_reasons").alias("anomaly_reasons"),
                          F.to_json("top_features").alias("top_features"), "model_version")


@query
def retrain_from_normal(spark, sf):
    scored = view(spark, sf, "scored_rows").withColumn("is_anomaly", F.col("prediction") == -1)
    results = scored.withColumn("raw_features", F.when(F.col("label") == "normal", F.to_json(F.struct(*rules.FEATURE_NAMES))))
    return M.normal_builds(results, _days(365), G.latest(results)).select("build_id", "label", "created_at", *[
        round_to(n, 4).alias(n) for n in rules.FEATURE_NAMES])


@query
def model_versions(spark, sf):
    folder = new_folder(spark, "models")
    rows = materialize(view(spark, sf, "feature_rows"), "rows")
    first = M.train(rows.filter("label = 'normal'"), trained_at="2024-01-30T00:00:00", version="1.0.0")
    second = M.train(rows, trained_at="2024-01-31T00:00:00", version="1.1.0")
    M.save_model(spark, first, f"{folder}/v1")
    M.save_model(spark, second, f"{folder}/v2")
    M.backup_model(spark, f"{folder}/v1", folder, "20240201_000000")
    return M.model_versions(spark, folder)


@query
def weighted_training_union(spark, sf):
    rows = materialize(view(spark, sf, "feature_rows").drop("created_at"), "rows")
    return M.weighted_training_union(rows, rows.filter("label = 'anomaly' AND suspicious_pattern_count > 0").drop("char_density"),
                                     rows.filter("base64_pattern_count > 3"))


# ------------------------------------------------------------------ evaluation

def _judged(spark, sf):
    return E.prepare_labels(view(spark, sf, "scored_rows"))


@query
def prepare_labels(spark, sf):
    rows = view(spark, sf, "scored_rows")
    flagged = rows.drop("label").withColumn("is_anomaly", F.col("prediction") == -1)
    plain = rows.drop("label")
    return E.prepare_labels(rows).select("build_id", F.col("y").alias("y_label")).join(
        E.prepare_labels(flagged).select("build_id", F.col("y").alias("y_flag")), "build_id").join(
        E.prepare_labels(plain).select("build_id", F.col("y").alias("y_none")), "build_id")


@query
def train_test_split(spark, sf):
    return E.train_test_split(view(spark, sf, "feature_rows")).select("build_id", "is_train")


@query
def threshold_detector(spark, sf):
    return view(spark, sf, "feature_rows").select("build_id", E.threshold_prediction().alias("prediction"))


def _split(spark, sf):
    return E.train_test_split(E.prepare_labels(view(spark, sf, "feature_rows")))


def _lof(rows):
    names = rules.FEATURE_NAMES
    scaled = P.fit_scaler(rows.filter("is_train")).transform(rows.select("build_id", "y", "is_train", *names))
    return K.lof_novelty(scaled.filter("is_train AND y = 1"), scaled.filter("NOT is_train"), names)


@query
def lof_novelty(spark, sf):
    rows = materialize(_split(spark, sf).select("build_id", "y", "is_train", *rules.FEATURE_NAMES), "split")
    return _lof(rows).select("build_id", round_to("lof", 6).alias("lof"), "prediction")


@query
def classification_metrics(spark, sf):
    return E.classification_metrics(_judged(spark, sf))


@query
def confusion_matrix(spark, sf):
    return E.confusion_matrix(_judged(spark, sf))


@query
def roc_auc(spark, sf):
    return E.roc_auc(_judged(spark, sf).withColumn("suspicion", -F.col("anomaly_score")), "suspicion")


@query
def permutation_importance(spark, sf):
    return E.permutation_importance(view(spark, sf, "feature_rows"))


@query
def ablation_study(spark, sf):
    return E.ablation_study(view(spark, sf, "feature_rows"))


@query
def contamination_sweep(spark, sf):
    rows = E.train_test_split(_judged(spark, sf))
    return E.contamination_sweep(rows.filter("is_train AND y = 1"), rows.filter("NOT is_train"))


@query
def n_estimators_sweep(spark, sf):
    return E.n_estimators_sweep(view(spark, sf, "feature_rows"))


@query
def stratified_kfold(spark, sf):
    return E.stratified_folds(E.prepare_labels(view(spark, sf, "feature_rows"))).select("build_id", "y", "fold")


@query
def cross_validation(spark, sf):
    return E.cross_validate(view(spark, sf, "feature_rows"))


@query
def model_comparison(spark, sf):
    rows = materialize(_split(spark, sf), "split")
    train, test = rows.filter("is_train AND y = 1"), rows.filter("NOT is_train")
    forest = M.train(train).score(test).withColumn("score", -F.col("anomaly_score"))
    flags = test.withColumn("prediction", E.threshold_prediction())
    return E.model_comparison({
        "IsolationForest": forest,
        "LOF": _lof(rows).withColumn("score", F.col("lof")),
        "Threshold": flags.withColumn("score", -F.col("prediction")),
    }, spark)


@query
def baseline_profile(spark, sf):
    return E.baseline_profile(materialize(view(spark, sf, "feature_rows").filter("label = 'normal'").select(*rules.FEATURE_NAMES), "rows"))


@query
def label_counts(spark, sf):
    return E.label_counts(view(spark, sf, "feature_rows"))


@query
def deviation_report(spark, sf):
    rows = materialize(view(spark, sf, "feature_rows").select("build_id", "label", *rules.FEATURE_NAMES), "rows")
    return E.deviation_report(rows, E.baseline_profile(rows.filter("label = 'normal'")))


@query
def flag_summary(spark, sf):
    return E.flag_summary(view(spark, sf, "build_results"))


# --------------------------------------------------------------------- serving

@query
def results_page(spark, sf):
    results = view(spark, sf, "build_results")
    last = G.latest(results)
    return G.results_page(results, 100, True, last - dt.timedelta(days=20), last - dt.timedelta(days=1))


@query
def latest_result_by_build(spark, sf):
    return G.latest_result_by_build(view(spark, sf, "build_results")).withColumns(
        {c: round_to(c, 9) for c in ("anomaly_score", "confidence")})


@query
def stored_results_served(spark, sf):
    """Scored rows written as results, read back and served."""
    path = new_folder(spark, "served")
    results = X.explain(view(spark, sf, "scored_rows"), dict.fromkeys(rules.FEATURE_NAMES, 0.0), dict.fromkeys(rules.FEATURE_NAMES, 1.0))
    append_by_period(T.result_rows(results, F.col("created_at")), path, period="month")
    # The newest row of a build travels whole: only the columns that are served go along.
    stored = spark.read.parquet(path).select("build_id", "created_at", "id", "is_anomaly", "anomaly_score", "prediction")
    return G.latest_result_by_build(stored).select(
        "build_id", "created_at", "is_anomaly", round_to("anomaly_score", 6).alias("anomaly_score"), "prediction")


@query
def anomaly_stats(spark, sf):
    results = view(spark, sf, "build_results")
    return G.anomaly_stats(results, _days(7), G.latest(results), 12)


@query
def anomaly_timeseries(spark, sf):
    results = view(spark, sf, "build_results")
    return G.anomaly_timeseries(results, "1 hour", _days(20), G.latest(results), 12)


@query
def anomaly_timeseries_weekly(spark, sf):
    results = view(spark, sf, "build_results")
    return G.anomaly_timeseries(results, "2 weeks", _days(25), G.latest(results), 12)


def _audit(spark, sf):
    return mark_processed(spark, sf).join(view(spark, sf, "deliveries").select("delivery_id", "received_at"), "delivery_id")


@query
def audit_stats(spark, sf):
    return G.audit_stats(_audit(spark, sf))


@query
def recent_raw_logs(spark, sf):
    return G.recent_raw_logs(view(spark, sf, "deliveries").select("delivery_id", "received_at", "provider"))


@query
def normal_vs_anomaly_series(spark, sf):
    return G.normal_vs_anomaly_series(G.bucketed(view(spark, sf, "build_results"), "1 day", 12))


@query
def score_band(spark, sf):
    rows = view(spark, sf, "build_results").withColumn("band", G.score_band(F.col("anomaly_score")))
    bands = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomalies"))
    return G.rate_percent(bands.withColumn("anomaly_rate", F.col("anomalies") / F.col("n"))).drop("anomaly_rate")


@query
def radar_features(spark, sf):
    return G.radar_features(view(spark, sf, "feature_rows")).withColumn("value", round_to("value", 4)) \
        .withColumn("bar", round_to(G.z_bar(F.col("value") / 10), 4))


# ------------------------------------------------------------------- streaming

DELIVERY = "delivery_id long, received_at timestamp_ntz, provider string, body string"


def _queue(spark, sf, name="deliveries", parts=4, condition="true", path=None):
    """Messages in the files of a queue folder, appended if it is there."""
    path = path or new_folder(spark, "queue")
    view(spark, sf, name).filter(condition).repartition(parts).write.mode("append").parquet(path)
    return path


def _features_out(spark, sf, files=None, dictionary=None):
    """The feature stream over a queue in which every third message is delivered a second time, in another file."""
    out = new_folder(spark, "stream-features")
    queue = _queue(spark, sf)
    _queue(spark, sf, parts=2, condition="delivery_id % 3 = 0", path=queue)
    J.stream_features(J.read_messages(spark, queue, DELIVERY, files), out, dictionary=dictionary, once=True).awaitTermination()
    return out


@query
def stream_features(spark, sf):
    event = F.from_json("event_distribution", "unique_templates long, template_entropy double, "
                        "suspicious_patterns long, external_ips long, external_urls long")
    return spark.read.parquet(f"{_features_out(spark, sf, 2)}/build_metrics").withColumn("e", event).select(
        "build_id", "repo_name", "duration_seconds", "log_line_count", "char_density", "error_count", "warning_count", "e.*", "created_at")


@query
def stream_parsed_logs(spark, sf):
    """Templates of streamed builds by the dictionary of an earlier mining run over every second delivery."""
    folder = new_folder(spark, "dictionary")
    lines = D.masked_lines(B.with_log_text(_builds(spark, sf).filter("delivery_id % 2 = 0")), "line_text", "delivery_id")
    _, assignment = D.mine_templates(materialize(lines.withColumnRenamed("delivery_id", "build_id"), "lines"))
    D.save_dictionary(assignment, folder, 1)
    out = _features_out(spark, sf, 2, folder)
    return spark.read.parquet(f"{out}/parsed_logs").select("raw_log_id", F.explode("templates").alias("t")).select("raw_log_id", "t.*")


@query
def stream_scoring(spark, sf):
    _, model = _trained(spark, sf)
    source = _features_out(spark, sf)
    out = new_folder(spark, "stream-results")
    messages = J.read_messages(spark, f"{source}/messages", "key string, value string, batch int")
    J.stream_scoring(messages.select("value"), model, out).awaitTermination()
    return spark.read.parquet(f"{out}/results").select("id", "build_id", "is_anomaly", round_to("anomaly_score", 6).alias("anomaly_score"), "prediction",
                                                       "anomaly_reasons", "top_features", "model_version", "created_at")


@query
def process_pending(spark, sf):
    """A queue drained by a third of its messages, rounded up, at a time: what each call handled and left."""
    out = new_folder(spark, "drained")
    messages = spark.read.schema(DELIVERY).parquet(_queue(spark, sf))
    handle = J.feature_batches(spark, out)
    n = messages.count() // 3 + 1
    calls = [(k, *J.drain(messages, handle, out, n)) for k in range(1, 5)]
    builds = spark.read.parquet(f"{out}/build_metrics").groupBy((F.col("batch") + 1).alias("call")).agg(F.count(F.lit(1)).alias("builds"))
    return spark.createDataFrame(calls, "call int, handled long, pending long").join(builds, "call", "left") \
        .withColumn("builds", F.coalesce("builds", F.lit(0)))


RESULT = "id long, build_id string, created_at timestamp_ntz, is_anomaly boolean, anomaly_score double, prediction int, confidence double, model_version string"


@query
def stream_counters(spark, sf):
    """Counters while a tenth of the results waits in the queue, and after the stream was started again."""
    out = new_folder(spark, "counters")
    queue = _queue(spark, sf, "build_results", condition="id % 10 <> 0")

    def run():
        J.stream_counters(J.read_messages(spark, queue, RESULT, 1), out).awaitTermination()

    def counters(step):
        rows = J.counter_rows(spark, out, spark.read.schema(RESULT).parquet(queue))
        return materialize(rows.agg(F.lit(step).alias("step"), F.sum("processed_total").alias("processed_total"),
                                    F.sum("anomalies_detected").alias("anomalies_detected"), F.max("backlog").alias("backlog")), "counters")

    run()
    _queue(spark, sf, "build_results", condition="id % 10 = 0", path=queue)
    before = counters("waiting")
    run()
    return before.unionByName(counters("done"))


def _states(spark, sf):
    out = new_folder(spark, "series")
    queue = _queue(spark, sf, "build_results")
    J.stream_timeseries(J.read_messages(spark, queue, RESULT, 1), "1 hour", out, digits=12).awaitTermination()
    return spark.read.parquet(f"{out}/states"), spark.read.schema(RESULT).parquet(queue)


@query
def stream_timeseries(spark, sf):
    states, _ = _states(spark, sf)
    return G.merged_series(states.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")), "1 hour", 12)


@query
def stream_anomaly_stats(spark, sf):
    """Statistics of the last week from the states that the stream keeps."""
    states, results = _states(spark, sf)
    return G.merged_stats(states, results, 168, G.latest(results), 12)


@query
def stream_quarantine(spark, sf):
    out = new_folder(spark, "quarantine")
    J.stream_quarantine(J.read_messages(spark, _queue(spark, sf), DELIVERY), out).awaitTermination()
    good, bad = (spark.read.parquet(f"{out}/{n}") for n in ("good", "dead_letters"))
    return good.select("delivery_id", F.lit("ok").alias("status")).unionByName(bad.select("delivery_id", F.col("reason").alias("status")))
