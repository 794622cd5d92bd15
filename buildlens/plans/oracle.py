"""SQL twins of the queries, written independently of the column expressions."""

from __future__ import annotations

from buildlens.functions import rules
from buildlens.plans.views import WEBHOOK_SECRET, with_views

ORACLE: dict[str, str] = {}
NAMES = rules.FEATURE_NAMES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def twin(name: str, views: list[str] | str, sql: str) -> None:
    used = [views] if isinstance(views, str) else views
    start = with_views(*used)
    body = sql.strip()
    ORACLE[name] = (start.rstrip() + ",\n" + body[5:]) if body.startswith("WITH ") else start + body


def matches(text: str, patterns: list[str], flags: str = "(?i)") -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, {lit(flags + p)}))" for p in patterns) + ")"


def line_hits(text: str, pattern: str) -> str:
    return f"len(list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, {lit(pattern)})))"


def words(values: list[str]) -> str:
    return "|".join(values)


BLANK = f"[^{rules.WHITESPACE_CLASS}]"
TRIM = "concat(" + ", ".join(f"chr({ord(c)})" for c in rules.WHITESPACE) + ")"
JSON = "CASE WHEN json_valid(body) THEN body END"
OK = f"coalesce(json_type({JSON}) = 'OBJECT', false)"


def js(path: str) -> str:
    return f"json_extract_string({JSON}, '$.{path}')"


# ------------------------------------------------------------ sources and sinks

twin("src_webhooks", "deliveries", f"""
SELECT NOT coalesce({OK}, false) AS corrupt, {js('action')} AS action,
  coalesce({js('workflow_run.id')}, {js('object_attributes.id')}, {js('build_id')}, {js('run_id')}) AS id,
  coalesce({js('repository.full_name')}, CASE WHEN json_type({JSON}, '$.repository') = 'VARCHAR' THEN {js('repository')} END,
           {js('project.path_with_namespace')}) AS full_name,
  {js('workflow_run.run_started_at')} AS started,
  length(coalesce({js('_enriched.raw_logs')}, {js('_enriched.log_content')})) AS log_chars,
  CAST(coalesce(json_array_length({JSON}, '$._enriched.steps'), json_array_length({JSON}, '$._extended.steps')) AS INTEGER) AS steps
FROM deliveries""")

twin("sink_raw_logs", "deliveries", """
SELECT delivery_id, provider AS source, body AS payload, delivery_id % 3 <> 0 AS signature_valid, received_at, false AS processed
FROM deliveries""")

_DOUBLES = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in NAMES)
twin("src_training_csv", "feature_rows", f"SELECT build_id, {_DOUBLES}, label FROM feature_rows WHERE label = 'normal'")
twin("sink_feature_csv", "feature_rows", "SELECT * EXCLUDE (created_at) FROM feature_rows")

twin("sink_feature_msgs", "feature_rows", f"""
SELECT build_id AS key, concat('r-', build_id) AS request_id, 'log-parser' AS source, log_line_count, duration_seconds,
  round({' + '.join(NAMES)}, 4) AS vector_sum, 12 AS vector_size, {lit(','.join(NAMES))} AS names FROM feature_rows""")

twin("src_feature_msgs", "feature_messages", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('b-', event_id) WHEN 1 THEN concat('r-', event_id) ELSE 'unknown' END AS build_id,
  CAST(CASE WHEN event_id % 5 < 2 THEN event_id END AS DOUBLE) AS duration_seconds,
  CASE WHEN event_id % 5 = 2 THEN event_id END AS log_line_count,
  CAST(CASE WHEN event_id % 5 = 0 THEN json_extract_string(value, '$.features.error_count') END AS BIGINT) AS error_count
FROM feature_messages WHERE coalesce(json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT', false)""")

_QUARANTINE = f"SELECT delivery_id, CASE WHEN coalesce({OK}, false) THEN 'ok' ELSE 'not a JSON object' END AS status FROM deliveries"
twin("quarantine_bad_msgs", "deliveries", _QUARANTINE)
twin("stream_quarantine", "deliveries", _QUARANTINE)

twin("sink_build_metrics", "feature_rows", """
SELECT build_id, duration_seconds, log_line_count, char_density, error_count, warning_count, unique_templates, template_entropy,
  suspicious_pattern_count AS suspicious_patterns, external_ip_count AS external_ips, external_url_count AS external_urls,
  strftime(date_trunc('month', created_at), '%Y-%m-%d') AS month FROM feature_rows""")


def _levels(score: str = "is_anomaly") -> str:
    parts = []
    for i, (name, high, very_high, reason) in enumerate(rules.FEATURE_THRESHOLDS):
        parts.append(f"SELECT build_id, {i} AS idx, '{name}' AS feature, "
                     f"CASE WHEN {name} >= {very_high} THEN {very_high} ELSE {high} END::DOUBLE AS threshold, {lit(reason)} AS reason, "
                     f"CASE WHEN {name} >= {very_high} THEN 'critical' ELSE 'warning' END AS severity "
                     f"FROM judged WHERE {score} AND {name} >= {high}")
    return " UNION ALL ".join(parts)


_REASONS = f"""
found AS ({_levels()}),
reasons AS (
  SELECT build_id, CAST(row_number() OVER (PARTITION BY build_id ORDER BY idx) - 1 AS INTEGER) AS position, feature, threshold, reason, severity FROM found
  UNION ALL SELECT build_id, 0, NULL, NULL, 'Build metrics within normal parameters', 'info' FROM judged WHERE NOT is_anomaly
  UNION ALL SELECT build_id, 0, NULL, NULL, 'Unusual combination of build metrics', 'warning' FROM judged
    WHERE is_anomaly AND build_id NOT IN (SELECT build_id FROM found))
"""

twin("sink_anomaly_results", "scored_rows", f"""
WITH judged AS (SELECT *, prediction = -1 OR suspicious_pattern_count >= 1 AS is_anomaly FROM scored_rows), {_REASONS},
counted AS (SELECT build_id, count(*) AS n, min_by(reason, position) AS r0, min_by(severity, position) AS s0 FROM reasons GROUP BY build_id)
SELECT j.build_id, is_anomaly,
  round(CASE WHEN suspicious_pattern_count >= 1 AND anomaly_score > 0 THEN -0.05 ELSE anomaly_score END, 6) AS anomaly_score, prediction,
  round(greatest(0.0, least(1.0, 0.5 - anomaly_score)), 6) AS confidence, 'unknown' AS model_version,
  CASE WHEN suspicious_pattern_count >= 1 THEN concat('Detected ', suspicious_pattern_count, ' suspicious command pattern(s) (e.g., xmrig, nc -e, curl|bash)') ELSE r0 END AS first_reason,
  CASE WHEN suspicious_pattern_count >= 1 THEN 'critical' ELSE s0 END AS first_severity,
  CAST(n + CASE WHEN suspicious_pattern_count >= 1 THEN 1 + CAST(external_ip_count >= 2 AS INTEGER) + CAST(duration_seconds > 1200 AS INTEGER) ELSE 0 END AS INTEGER) AS n_reasons,
  5 AS n_top, log_line_count AS raw_lines
FROM judged j JOIN counted c ON c.build_id = j.build_id""")

_SIMPLE = f"regexp_replace(regexp_replace(line, '\\p{{Nd}}+', '<NUM>', 'g'), '(?i)[a-f0-9]{{32,}}', '<HASH>', 'g')"
_SHORT = f"left(regexp_replace(regexp_replace(line, '\\p{{Nd}}+', '<NUM>', 'g'), '(?i)[a-f0-9]{{7,}}', '<HASH>', 'g'), 100)"
_LINES = """
lines AS (SELECT build_id, CAST(generate_subscripts(string_split(raw_logs, chr(10)), 1) - 1 AS INTEGER) AS line_no,
          unnest(string_split(raw_logs, chr(10))) AS line FROM all_logs)"""
_TEMPLATES = f"""{_LINES},
simple AS (SELECT build_id, line_no, trim({_SIMPLE}, {TRIM}) AS template FROM lines WHERE regexp_matches(line, {lit(BLANK)})),
ids AS (SELECT *, left(md5(template), 12) AS template_id FROM simple)"""

twin("sink_parsed_logs", "all_logs", f"""
WITH {_TEMPLATES},
counts AS (SELECT build_id, template_id, count(*) AS n, min(line_no) AS first_line FROM ids GROUP BY ALL)
SELECT build_id AS raw_log_id, string_agg(template_id, ',' ORDER BY first_line, template_id) AS event_ids,
  CAST(count(*) AS INTEGER) AS n_templates, CAST(sum(n) AS BIGINT) AS n_lines FROM counts GROUP BY build_id""")

twin("assemble_log_files", "log_files", """
SELECT run_id, string_agg(concat('=== ', file_name, ' ===', chr(10), content), concat(chr(10), chr(10)) ORDER BY file_no) AS raw_logs,
  CAST(count(*) AS INTEGER) AS file_count, CAST(sum(len(string_split(content, chr(10)))) AS INTEGER) AS total_lines,
  string_agg(concat(file_name, ':', len(string_split(content, chr(10)))), ',' ORDER BY file_no) AS files,
  string_agg(concat(chr(10), '=== Job: ', file_name, ' ===', chr(10), content), '' ORDER BY file_no) AS log_content
FROM log_files WHERE content <> '' GROUP BY run_id""")

# --------------------------------------------------------------- normalisation

_KIND = "CASE build_no % 8 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'github' WHEN 3 THEN 'generic' WHEN 4 THEN 'github' ELSE 'generic' END"
_SHAPES = f"""
shapes AS (SELECT p.*, build_no AS delivery_id, build_no % 8 AS shape, {_KIND} AS kind, l.raw_logs
           FROM delivery_parts p JOIN (SELECT build_no, raw_logs FROM build_logs) l USING (build_no) WHERE build_no % 8 < 6)"""

twin("detect_provider", "delivery_parts", f"""
WITH {_SHAPES} SELECT delivery_id, kind AS provider_kind,
  CASE shape WHEN 0 THEN 'github' WHEN 2 THEN 'github' WHEN 4 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'unknown' END AS header_provider FROM shapes""")

twin("extract_build_id", "delivery_parts", f"""
WITH {_SHAPES} SELECT delivery_id,
  CASE WHEN kind = 'github' THEN CASE WHEN build_no = 0 THEN 'completed' ELSE CAST(build_no AS VARCHAR) END
       WHEN kind = 'gitlab' THEN CAST(build_no AS VARCHAR) WHEN shape = 3 THEN concat('custom-', build_no) ELSE 'unknown' END AS build_id,
  CASE kind WHEN 'github' THEN concat('github-', build_no) WHEN 'gitlab' THEN concat('gitlab-', build_no) END AS metrics_id FROM shapes""")

_SECONDS = "epoch(strptime(finished, '%Y-%m-%dT%H:%M:%S')) - epoch(strptime(started, '%Y-%m-%dT%H:%M:%S'))"
twin("normalize_build", "delivery_parts", f"""
WITH {_SHAPES} SELECT delivery_id,
  CASE WHEN shape IN (0, 1, 2, 4) THEN CAST(build_no AS VARCHAR) ELSE 'unknown' END AS build_id,
  repo_name, CASE shape WHEN 0 THEN 'main' WHEN 1 THEN 'main' WHEN 2 THEN 'dev' ELSE '' END AS branch,
  CASE WHEN shape IN (0, 1) THEN sha ELSE '' END AS commit_sha,
  CAST(CASE shape WHEN 0 THEN floor(duration_seconds) WHEN 1 THEN CAST(floor(duration_seconds) AS BIGINT) % 200
       WHEN 2 THEN {_SECONDS} WHEN 4 THEN {_SECONDS} ELSE 0 END AS DOUBLE) AS duration_seconds,
  md5(CASE WHEN shape IN (0, 1, 3) THEN raw_logs WHEN shape = 4 THEN 'only one line' ELSE '' END) AS logs_md5,
  CAST(CASE shape WHEN 0 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS INTEGER) AS n_steps,
  CASE WHEN kind = 'generic' THEN 'unknown' ELSE kind END AS provider FROM shapes""")

twin("enrich_envelope", "deliveries", f"""
SELECT delivery_id, provider, delivery_id % 3 <> 0 AS signature_valid, delivery_id % 8 IN (0, 1, 3, 4) AS logs_fetched,
  36 AS id_length, strftime(received_at, '%Y-%m-%dT%H:%M:%S') AS received_at FROM deliveries WHERE {OK}""")

twin("filter_completed", "deliveries", f"""
SELECT delivery_id, {js('action')} AS action FROM deliveries WHERE {OK} AND (
  ({js('action')} = 'completed' AND {js('workflow_run.status')} = 'completed')
  OR {js('object_attributes.status')} IN ('success', 'failed', 'canceled'))""")

twin("split_repo", "delivery_parts", f"""
WITH {_SHAPES} SELECT delivery_id, CASE WHEN shape IN (0, 2, 4, 5) THEN 'org' END AS owner,
  CASE WHEN shape IN (0, 2, 4, 5) THEN split_part(repo_name, '/', 2) END AS repo,
  CASE WHEN shape IN (0, 2, 4, 5) THEN CAST(build_no AS VARCHAR) END AS run_id,
  CASE shape WHEN 0 THEN 'main' WHEN 2 THEN '' WHEN 5 THEN 'main' END AS head_branch,
  CASE shape WHEN 0 THEN 'completed' WHEN 2 THEN 'completed' WHEN 4 THEN 'requested' WHEN 5 THEN 'completed' END AS action FROM shapes""")


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


_KEY = WEBHOOK_SECRET.encode().ljust(64, b"\0")
_INNER, _OUTER = (_blob(bytes(b ^ pad for b in _KEY)) for pad in (0x36, 0x5C))
_HMAC = f"sha256({_OUTER} || unhex(sha256({_INNER} || encode(body))))"
twin("signature_audit", "deliveries", f"""
WITH signed AS (SELECT *, CASE WHEN provider = 'github' THEN CASE WHEN delivery_id % 3 = 0 THEN 'sha256=00' ELSE concat('sha256=', {_HMAC}) END END AS hub_signature FROM deliveries)
SELECT delivery_id, hub_signature, provider <> 'unknown' AND delivery_id % 3 <> 0 AS valid,
  provider = 'unknown' OR delivery_id % 3 <> 0 AS valid_in_development FROM signed""")

_TS = "strptime({0}, '%Y-%m-%d %H:%M:%S')"
twin("duration_strict", "run_times", """
SELECT event_id, CASE WHEN event_id % 9 IN (0, 1, 2) THEN 90.0 ELSE 0.0 END::DOUBLE AS seconds FROM run_times""")
twin("duration_iso", "run_times", """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN 90.0 WHEN 1 THEN 90.0 WHEN 2 THEN 90.0 WHEN 3 THEN 89.875 WHEN 4 THEN 7290.0
  WHEN 6 THEN 90.0 ELSE 0.0 END::DOUBLE AS seconds FROM run_times""")
_AT = "try_cast(regexp_replace({0}, '(Z|[+]02:00)$', '') AS TIMESTAMP) - CASE WHEN {0} LIKE '%+02:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END"
twin("duration_fallback", "run_times", f"""
WITH t AS (SELECT *, coalesce(nullif(started, ''), nullif(created, '')) AS a, coalesce(nullif(finished, ''), nullif(started, '')) AS b FROM run_times),
s AS (SELECT event_id, reported, coalesce(CAST(floor(greatest(0, epoch(({_AT.format('b')})) - epoch(({_AT.format('a')})))) AS BIGINT), 0) AS run_seconds,
  floor(epoch(({_AT.format('finished')})) - epoch(({_AT.format("nullif(created, '')")}))) AS p FROM t)
SELECT event_id, run_seconds, coalesce(nullif(reported, 0), p) AS pipeline_seconds, coalesce(nullif(reported, 0), run_seconds) AS build_seconds FROM s""")

twin("job_step_counts", ["deliveries", "build_jobs"], f"""
WITH counted AS (SELECT build_no, CAST(count(DISTINCT job_name) AS INTEGER) AS jobs,
    CAST(count(*) FILTER (job_name <> 'signup') AS INTEGER) AS steps,
    CAST(count(*) FILTER (job_name <> 'signup' AND status = 'completed') AS INTEGER) AS done,
    CAST(count(*) FILTER (job_name <> 'signup' AND conclusion = 'failure') AS INTEGER) AS failed,
    coalesce(string_agg(concat(step_name, '/', number), ',' ORDER BY job_name, event_id) FILTER (job_name <> 'signup'), '') AS details
  FROM build_jobs GROUP BY build_no)
SELECT delivery_id, CASE WHEN delivery_id % 8 = 0 THEN jobs ELSE 0 END AS job_count, CASE WHEN delivery_id % 8 = 0 THEN steps ELSE 0 END AS step_count,
  CASE WHEN delivery_id % 8 = 0 THEN done ELSE 0 END AS completed_steps, CASE WHEN delivery_id % 8 = 0 THEN failed ELSE 0 END AS failed_steps,
  CASE WHEN delivery_id % 8 = 0 THEN details ELSE '' END AS steps
FROM deliveries JOIN counted ON build_no = delivery_id WHERE {OK}""")

_STEP_ROWS = "CAST(len(string_split(raw_logs, chr(10))) AS INTEGER)"
twin("step_durations", "delivery_parts", f"""
WITH {_SHAPES}
SELECT CAST(build_no AS VARCHAR) AS build_id, s.step_no, s.step_name,
  round(CASE WHEN shape = 2 AND s.step_no = 0 THEN {_SECONDS} + 0.5 - CAST(micros AS INTEGER) / 1000000.0 WHEN shape = 2 THEN {_SECONDS} ELSE 0.0 END, 6)::DOUBLE AS duration_seconds,
  CASE WHEN shape = 0 THEN 0 WHEN s.step_no = 1 THEN 2 ELSE {_STEP_ROWS} END AS line_count,
  CASE shape WHEN 0 THEN 0 WHEN 2 THEN {_STEP_ROWS} + 2 ELSE {_STEP_ROWS} END AS total_log_lines
FROM shapes JOIN (VALUES (0, 0, 'checkout'), (0, 1, 'run_tests'), (2, 0, 'checkout'), (2, 1, 'run_tests'), (4, 0, 'deploy')) s(of_shape, step_no, step_name)
  ON s.of_shape = shape""")

# -------------------------------------------------------------------- log text

twin("log_lines", "delivery_parts", f"""
WITH {_SHAPES}, texts AS (SELECT delivery_id, CASE WHEN shape = 2 THEN list_concat(string_split(raw_logs, chr(10)), ['one', 'two 2'])
    WHEN shape IN (0, 1, 3, 4) THEN string_split(raw_logs, chr(10)) ELSE [] END AS l FROM shapes)
SELECT delivery_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM texts""")

_TEXT = "CASE WHEN contains(raw_logs, chr(10)) THEN raw_logs ELSE '' END"
_MEASURES = {
    "log_line_count": line_hits("t", BLANK),
    "char_density": f"round(list_sum([length(x) for x in string_split(t, chr(10))]) / greatest({line_hits('t', BLANK)}, 1), 2)",
    "error_count": f"len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(lower(x), '{words(rules.ERROR_KEYWORDS)}')))",
    "warning_count": f"len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(lower(x), '{words(rules.WARNING_KEYWORDS)}')))",
}
twin("line_volume", "all_logs", f"""
SELECT build_id, CAST({_MEASURES['log_line_count']} AS BIGINT) AS log_line_count, CAST({_MEASURES['char_density']} AS DOUBLE) AS char_density
FROM (SELECT build_id, {_TEXT} AS t FROM all_logs)""")

_RAW_LINES = "CASE WHEN raw_logs = '' THEN {0} ELSE len(string_split(raw_logs, chr(10))) END"
twin("line_volume_raw", "all_logs", f"""
SELECT build_id, CAST({_RAW_LINES.format(0)} AS BIGINT) AS lines, CAST({_RAW_LINES.format(1)} AS BIGINT) AS trace_lines,
  round(length(raw_logs) / greatest({_RAW_LINES.format(0)}, 1), 2) AS char_density FROM all_logs""")


def _keyword_lines(values: list[str]) -> str:
    return f"CAST(len(list_filter(string_split(raw_logs, chr(10)), lambda x: regexp_matches(lower(x), '{words(values)}'))) AS INTEGER)"


twin("keyword_line_counts", "all_logs", f"""
SELECT build_id, {_keyword_lines(rules.ERROR_KEYWORDS)} AS error_count, {_keyword_lines(rules.WARNING_KEYWORDS)} AS warning_count FROM all_logs""")
twin("keyword_token_counts", "all_logs", f"""
SELECT build_id, CAST({matches('raw_logs', [f'\\b({words(rules.ERROR_KEYWORDS)})\\b'])} AS INTEGER) AS error_count,
  CAST({matches('raw_logs', [f'\\b({words(rules.WARNING_KEYWORDS)})\\b'])} AS INTEGER) AS warning_count FROM all_logs""")
twin("keyword_line_regex", "all_logs", f"""
SELECT build_id, CAST({line_hits('raw_logs', '(?i)' + words(rules.JOB_ERROR_KEYWORDS))} AS INTEGER) AS error_count,
  CAST({line_hits('raw_logs', '(?i)' + words(rules.JOB_WARNING_KEYWORDS))} AS INTEGER) AS warning_count,
  CAST({line_hits('raw_logs', '(?i)' + words(rules.GENERATED_WARNING_KEYWORDS))} AS INTEGER) AS generated_warning_count FROM all_logs""")

twin("suspicious_count", "all_logs", f"SELECT build_id, CAST({matches('raw_logs', rules.SUSPICIOUS_PATTERNS)} AS INTEGER) AS suspicious_pattern_count FROM all_logs")
twin("suspicious_count_strict", "all_logs", f"""
SELECT build_id, CAST({matches('raw_logs', rules.SUSPICIOUS_COMMANDS_STRICT)} AS INTEGER) AS suspicious_commands,
  CAST({' + '.join(line_hits('raw_logs', '(?i)' + p) for p in rules.SUSPICIOUS_LINE_PATTERNS)} AS INTEGER) AS suspicious_lines FROM all_logs""")

_PART = "CAST(split_part(ip, '.', {0}) AS INTEGER)"
_PRIVATE = (f"({_PART.format(1)} IN (10, 127) OR ({_PART.format(1)} = 172 AND {_PART.format(2)} BETWEEN 16 AND 31) "
            f"OR ({_PART.format(1)} = 192 AND {_PART.format(2)} = 168))")


def _ips(text: str, pattern: str, keep: str) -> str:
    return f"len(list_filter(list_distinct(regexp_extract_all({text}, {lit(pattern)})), lambda ip: {keep}))"


def _starts(prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with(ip, '{p}')" for p in prefixes) + ")"


_PUBLIC_IPS = _ips("{0}", rules.IP_PATTERN, f"NOT {_PRIVATE}").replace("{3}", "{{3}}").replace("{1,3}", "{{1,3}}")
_STRICT_IPS = _ips("raw_logs", rules.IP_PATTERN, f"NOT {_starts(rules.NON_PUBLIC_PREFIXES_STRICT)} AND "
                   + " AND ".join(f"{_PART.format(i)} <= 255" for i in (1, 2, 3, 4)))
twin("external_ip_count", "all_logs", f"SELECT build_id, CAST({_PUBLIC_IPS.format('raw_logs')} AS INTEGER) AS external_ip_count FROM all_logs")
twin("external_ip_count_strict", "all_logs", f"""
SELECT build_id, CAST({_STRICT_IPS} AS INTEGER) AS unique_ips_contacted,
  CAST({_ips('raw_logs', rules.IP_OCTET_PATTERN, 'NOT ' + _starts(rules.NON_PUBLIC_PREFIXES_GENERATED))} AS INTEGER) AS external_ips FROM all_logs""")

_DOMAIN = "split_part(lower(split_part({0}, '/', 1)), ':', 1)"


def _trusted(domain: str, trusted: list[str], dot: bool = False) -> str:
    if dot:
        return f"len(list_filter({sql_list(trusted)}, lambda s: ends_with(concat('.', {domain}), concat('.', s)))) > 0"
    return f"len(list_filter({sql_list(trusted)}, lambda s: ends_with({domain}, s))) > 0"


def _untrusted_urls(text: str, dot: bool = False) -> str:
    return (f"list_filter([{_DOMAIN.format('u')} for u in regexp_extract_all({text}, {lit('(?i)' + rules.URL_PATTERN)}, 1)], "
            f"lambda d: NOT ({_trusted('d', rules.TRUSTED_DOMAINS, dot)}))")


def _untrusted_hosts(text: str, trusted: list[str]) -> str:
    return f"list_filter(regexp_extract_all({text}, {lit(rules.HOST_PATTERN)}, 1), lambda h: NOT ({_trusted('lower(h)', trusted)}))"


twin("external_url_count", "url_texts", f"""
SELECT build_id, CAST(len({_untrusted_urls('raw_logs')}) AS INTEGER) AS external_url_count,
  CAST(len({_untrusted_urls('raw_logs', True)}) AS INTEGER) AS external_url_count_strict_dot FROM url_texts""")
twin("external_url_variants", "url_texts", f"""
SELECT build_id, CAST(len({_untrusted_hosts('raw_logs', rules.TRUSTED_DOMAINS_STRICT)}) AS INTEGER) AS external_urls_count,
  CAST(len(list_distinct({_untrusted_hosts('raw_logs', rules.TRUSTED_DOMAINS_GENERATED)})) AS INTEGER) AS external_hosts FROM url_texts""")
_URLS = f"""
found AS (SELECT build_id, regexp_extract_all(raw_logs, {lit('(?i)' + rules.URL_PATTERN)}, 1) AS u FROM url_texts),
urls AS (SELECT build_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS url_no, unnest(u) AS url FROM found),
split AS (SELECT *, {_DOMAIN.format('url')} AS domain FROM urls),
judged AS (SELECT *, {_trusted('domain', rules.TRUSTED_DOMAINS)} AS is_trusted FROM split)"""
twin("url_trust_split", "url_texts", f"WITH {_URLS} SELECT * FROM judged")
twin("top_untrusted_domains", "url_texts", f"""
WITH {_URLS} SELECT domain, count(*) AS n FROM judged WHERE NOT is_trusted GROUP BY domain ORDER BY n DESC, domain LIMIT 10""")
twin("untrusted_url_alert", "url_texts", f"""
WITH {_URLS} SELECT build_id, CAST(count(*) AS INTEGER) AS untrusted_urls,
  array_to_string(list_slice(list_sort(list(DISTINCT domain)), 1, 10), ',') AS sample_domains
FROM judged WHERE NOT is_trusted GROUP BY build_id HAVING count(*) > 6""")
twin("trusted_suffix_join", "url_texts", f"WITH {_URLS} SELECT build_id, url_no, domain FROM judged WHERE NOT is_trusted")

twin("base64_count", "all_logs", f"SELECT build_id, CAST({matches('raw_logs', [rules.BASE64_PATTERN])} AS INTEGER) AS base64_pattern_count FROM all_logs")
twin("base64_count_variants", "all_logs", f"""
SELECT build_id, CAST({matches('raw_logs', [rules.BASE64_STRICT_PATTERN], '')} AS INTEGER) AS base64_patterns,
  CAST({line_hits('raw_logs', rules.BASE64_LINE_PATTERN)} AS INTEGER) AS base64_lines FROM all_logs""")

# ------------------------------------------------------------------- templates

_TOKENS = f"list_filter(regexp_split_to_array(line, {lit(rules.TOKEN_DELIMITERS)}), lambda t: t <> '')"
twin("tokenize_line", "all_logs", f"""
WITH {_LINES} SELECT build_id, line_no, CAST(len({_TOKENS}) AS INTEGER) AS n_tokens, coalesce(array_to_string({_TOKENS}, ' '), '') AS tokens FROM lines""")
twin("simple_template", "all_logs", f"""
WITH {_LINES} SELECT build_id, line_no, trim({_SIMPLE}, {TRIM}) AS template, {_SHORT} AS short_template FROM lines""")
twin("template_id", "all_logs", f"""
WITH {_LINES} SELECT build_id, line_no, left(md5(coalesce(array_to_string({_TOKENS}, ' '), '')), 12) AS template_id FROM lines""")
twin("template_distribution", "all_logs", f"WITH {_TEMPLATES} SELECT template_id, template, count(*) AS n FROM ids GROUP BY ALL")
twin("recent_templates", "all_logs", f"""
WITH {_TEMPLATES}, seen AS (SELECT template_id, template, count(*) AS n, min(ROW(build_id, line_no)) AS seen FROM ids GROUP BY ALL)
SELECT template_id, template, n FROM seen ORDER BY seen DESC, template_id LIMIT 50""")
_PER_BUILD = f"""{_TEMPLATES},
counts AS (SELECT build_id, template, count(*) AS c FROM ids GROUP BY ALL),
per_build AS (SELECT build_id, count(*) AS u, sum(c) AS n, -sum(c / total * log2(c / total)) AS h
  FROM (SELECT *, sum(c) OVER (PARTITION BY build_id) AS total FROM counts) GROUP BY build_id),
entropy AS (SELECT a.build_id, coalesce(u, 0) AS unique_templates,
  CASE WHEN coalesce(u, 0) <= 1 THEN 0.0 ELSE round(h, 4) END::DOUBLE AS template_entropy
  FROM all_logs a LEFT JOIN per_build p ON p.build_id = a.build_id)"""
twin("unique_templates", "all_logs", f"WITH {_PER_BUILD} SELECT build_id, unique_templates FROM entropy")
twin("template_entropy", "all_logs", f"WITH {_PER_BUILD} SELECT build_id, template_entropy FROM entropy")

_MARK = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, {lit(p)}, 1), '')" for p in rules.STEP_MARKERS) + ")"
_STEPS = f"""
step_lines AS (SELECT build_id, generate_subscripts(string_split(raw_logs, chr(10)), 1) AS line_no, unnest(string_split(raw_logs, chr(10))) AS line FROM step_logs),
marked AS (SELECT *, {_MARK} AS mark FROM step_lines),
numbered AS (SELECT *, count(mark) OVER (PARTITION BY build_id ORDER BY line_no) AS step FROM marked),
none AS (SELECT build_id FROM marked GROUP BY build_id HAVING count(mark) = 0),
steps AS (SELECT build_id, CAST(step - 1 AS INTEGER) AS step_no, min(mark) AS name, CAST(count(*) AS INTEGER) AS line_count,
    string_agg(line, chr(10) ORDER BY line_no) AS step_text FROM numbered WHERE step > 0 GROUP BY build_id, step
  UNION ALL SELECT build_id, 0, 'unknown', CAST(count(*) AS INTEGER), string_agg(line, chr(10) ORDER BY line_no) FROM numbered
    WHERE build_id IN (SELECT build_id FROM none) GROUP BY build_id),
distribution AS (SELECT build_id, name, max_by(line_count, step_no) AS lines FROM steps GROUP BY build_id, name)"""
_MARKED = _STEPS.replace("FROM step_logs", "FROM marked_logs")
twin("detect_steps", "marked_logs", f"WITH {_MARKED} SELECT build_id, step_no, name, line_count, md5(step_text) AS lines_md5 FROM steps")
twin("event_distribution", "marked_logs", f"WITH {_MARKED} SELECT build_id, name, lines FROM distribution")
_SHARES = ", ".join(f"round(coalesce(sum(lines) FILTER (name = '{s}'), 0) / CASE WHEN sum(lines) = 0 THEN 1 ELSE sum(lines) END, 6) AS event_{s}"
                    for s in rules.STANDARD_STEPS)
twin("event_proportions", "marked_logs", f"WITH {_MARKED} SELECT build_id, {_SHARES} FROM distribution GROUP BY build_id")

twin("build_features_12", "all_logs", f"""
WITH all_texts AS (SELECT build_id, repo_name, duration_seconds, step_count, {_TEXT} AS t FROM all_logs),
texts AS (SELECT build_id, t AS raw_logs FROM all_texts),
{_PER_BUILD.replace('all_logs', 'texts')}
SELECT a.build_id, repo_name, duration_seconds, CAST({_MEASURES['log_line_count']} AS BIGINT) AS log_line_count,
  CAST({_MEASURES['char_density']} AS DOUBLE) AS char_density, CAST({_MEASURES['error_count']} AS BIGINT) AS error_count,
  CAST({_MEASURES['warning_count']} AS BIGINT) AS warning_count, step_count, unique_templates, template_entropy,
  CAST({matches('t', rules.SUSPICIOUS_PATTERNS)} AS BIGINT) AS suspicious_pattern_count,
  CAST({_PUBLIC_IPS.format('t')} AS BIGINT) AS external_ip_count,
  CAST(len({_untrusted_urls('t')}) AS BIGINT) AS external_url_count,
  CAST({matches('t', [rules.BASE64_PATTERN])} AS BIGINT) AS base64_pattern_count
FROM all_texts a JOIN entropy e ON e.build_id = a.build_id""")

_STRICT = {
    "log_line_count": _RAW_LINES.format(0),
    "char_density": f"round(length(raw_logs) / greatest({_RAW_LINES.format(0)}, 1), 2)",
    "error_count": _keyword_lines(rules.ERROR_KEYWORDS),
    "warning_count": _keyword_lines(rules.WARNING_KEYWORDS),
    "ips": _STRICT_IPS,
    "urls": f"len({_untrusted_hosts('raw_logs', rules.TRUSTED_DOMAINS_STRICT)})",
    "base64": matches("raw_logs", [rules.BASE64_STRICT_PATTERN], ""),
    "commands": matches("raw_logs", rules.SUSPICIOUS_COMMANDS_STRICT),
}
_CORE = f"""CAST({_STRICT['log_line_count']} AS BIGINT) AS log_line_count, {_STRICT['char_density']} AS char_density,
  CAST({_STRICT['error_count']} AS BIGINT) AS error_count, CAST({_STRICT['warning_count']} AS BIGINT) AS warning_count"""
twin("build_features_16", "step_logs", f"""
WITH {_STEPS}, shares AS (SELECT build_id, {_SHARES} FROM distribution GROUP BY build_id),
counted AS (SELECT build_id, count(*) AS step_count FROM steps GROUP BY build_id)
SELECT l.build_id, duration_seconds, {_CORE}, step_count, s.* EXCLUDE (build_id),
  CAST({_STRICT['ips']} AS BIGINT) AS unique_ips_contacted, CAST({_STRICT['urls']} AS BIGINT) AS external_urls_count,
  CAST({_STRICT['base64']} AS BIGINT) AS base64_patterns, CAST({_STRICT['commands']} AS BIGINT) AS suspicious_commands
FROM step_logs l JOIN shares s ON s.build_id = l.build_id JOIN counted c ON c.build_id = l.build_id""")
twin("features_from_raw_text", "step_logs", f"""
WITH {_STEPS}, counted AS (SELECT build_id, count(*) AS step_count FROM steps GROUP BY build_id),
short AS (SELECT build_id, {_SHORT} AS template, count(*) AS c FROM step_lines GROUP BY ALL),
h AS (SELECT build_id, count(*) AS unique_templates, CASE WHEN count(*) = 1 THEN 0.0 ELSE round(-sum(c / total * log2(c / total)), 4) END AS template_entropy
  FROM (SELECT *, sum(c) OVER (PARTITION BY build_id) AS total FROM short) GROUP BY build_id)
SELECT l.build_id, (epoch_us(finished_at) - epoch_us(created_at)) / 1000000 AS duration_seconds, {_CORE}, step_count,
  unique_templates, CAST(template_entropy AS DOUBLE) AS template_entropy,
  CAST({_STRICT['commands']} AS BIGINT) AS suspicious_pattern_count, CAST({_STRICT['ips']} AS BIGINT) AS external_ip_count,
  CAST({_STRICT['urls']} AS BIGINT) AS external_url_count, CAST({_STRICT['base64']} AS BIGINT) AS base64_pattern_count
FROM step_logs l JOIN counted c ON c.build_id = l.build_id JOIN h ON h.build_id = l.build_id""")

# ----------------------------------------------------------------------- joins

twin("recent_builds_status", ["build_logs", "build_results"], """
SELECT b.build_id, repo_name, branch, duration_seconds, log_line_count, error_count, b.created_at, is_anomaly, anomaly_score,
  CASE WHEN is_anomaly THEN concat('[{"reason":"result ', id, '","severity":"warning"}]') END AS anomaly_reasons
FROM build_logs b LEFT JOIN build_results r ON r.build_id = b.build_id ORDER BY b.created_at DESC""")
_PROCESSED = f"coalesce({OK}, false)"
twin("mark_processed", "deliveries", f"""
SELECT delivery_id, provider AS source, {_PROCESSED} AS processed,
  CASE WHEN {_PROCESSED} THEN TIMESTAMP '2024-02-01 00:00:00' END AS processed_at FROM deliveries""")

# ----------------------------------------------------------------------- model


def _filled(name: str) -> str:
    return f"round(coalesce({name}, (SELECT median({name}) FROM feature_rows_gaps)), 6)::DOUBLE AS {name}"


twin("impute_median", "feature_rows_gaps", f"""
SELECT build_id, {', '.join(_filled(n) for n in NAMES)} FROM feature_rows_gaps""")


def _z(name: str) -> str:
    return (f"round(({name} - (SELECT avg({name}) FROM feature_rows)) / (SELECT CASE WHEN stddev_pop({name}) = 0 THEN 1 ELSE stddev_pop({name}) END "
            f"FROM feature_rows), 6)::DOUBLE AS {name}")


twin("standard_scale", "feature_rows", f"SELECT build_id, {', '.join(_z(n) for n in NAMES)} FROM feature_rows")
_VECTOR = ", ".join(f"coalesce({n}, 0)::DOUBLE" for n in NAMES)
twin("feature_vector", "feature_rows_gaps", f"""
SELECT build_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS position, unnest(v) AS value
FROM (SELECT build_id, [{_VECTOR}] AS v FROM feature_rows_gaps)""")
twin("training_stats", "scored_rows", f"""
SELECT count(*) AS n_samples, 12 AS n_features, count(*) FILTER (prediction = -1) AS n_anomalies_detected,
  round(count(*) FILTER (prediction = -1) / count(*), 4) AS anomaly_ratio, round(avg(anomaly_score), 4) AS score_mean, round(stddev_pop(anomaly_score), 4) AS score_std,
  {', '.join(f'round(avg({n}), 4) AS mean_{n}, round(stddev_samp({n}), 4) AS std_{n}' for n in NAMES)} FROM scored_rows""")
twin("confidence", "scored_rows", "SELECT build_id, round(greatest(0.0, least(1.0, 0.5 - anomaly_score)), 6) AS confidence FROM scored_rows")
twin("security_rules", "scored_rows", """
WITH hits AS (SELECT * FROM scored_rows WHERE suspicious_pattern_count >= 1)
SELECT build_id, 0 AS position, 'suspicious_pattern_count' AS feature, suspicious_pattern_count::DOUBLE AS value, 'critical' AS severity,
  concat('Detected ', suspicious_pattern_count, ' suspicious command pattern(s) (e.g., xmrig, nc -e, curl|bash)') AS reason FROM hits
UNION ALL SELECT build_id, 1, 'external_ip_count', external_ip_count::DOUBLE, 'critical', concat('Multiple external IP connections (', external_ip_count, ') with suspicious patterns')
  FROM hits WHERE external_ip_count >= 2
UNION ALL SELECT build_id, CASE WHEN external_ip_count >= 2 THEN 2 ELSE 1 END, 'duration_seconds', round(duration_seconds, 4), 'critical',
  concat('Extended build duration (', duration_seconds, 's) with suspicious patterns - possible cryptomining') FROM hits WHERE duration_seconds > 1200""")
twin("rule_override", "scored_rows", """
SELECT build_id, prediction = -1 OR suspicious_pattern_count >= 1 AS is_anomaly,
  round(CASE WHEN suspicious_pattern_count >= 1 AND anomaly_score > 0 THEN -0.05 ELSE anomaly_score END, 6)::DOUBLE AS anomaly_score, prediction FROM scored_rows""")
twin("threshold_reasons", "scored_rows", f"""
WITH judged AS (SELECT *, prediction = -1 AS is_anomaly FROM scored_rows), {_REASONS}
SELECT build_id, position, feature, threshold, reason, severity FROM reasons""")
_Z = " UNION ALL ".join(
    f"SELECT build_id, {i} AS idx, '{n}' AS feature, CASE WHEN s.std_{n} > 0 THEN abs(({n} - s.mean_{n}) / s.std_{n}) ELSE 0 END AS z FROM scored_rows, stats s"
    for i, n in enumerate(NAMES))
_STATS = "stats AS (SELECT " + ", ".join(f"round(avg({n}), 4) AS mean_{n}, round(stddev_samp({n}), 4) AS std_{n}" for n in NAMES) + " FROM {0})"
twin("top_contributions", "scored_rows", f"""
WITH {_STATS.format('scored_rows')}, z AS ({_Z}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY build_id ORDER BY round(z, 2) DESC, idx) - 1 AS INTEGER) AS position FROM z)
SELECT build_id, position, feature, round(z, 2)::DOUBLE AS z_score, CASE WHEN z > 2 THEN 'high' ELSE 'normal' END AS deviation FROM ranked WHERE position < 5""")
twin("retrain_from_normal", "scored_rows", f"""
SELECT build_id, 'normal' AS label, created_at, {', '.join(f'round({n}::DOUBLE, 4) AS {n}' for n in NAMES)} FROM scored_rows
WHERE prediction <> -1 AND label = 'normal' AND created_at > (SELECT max(created_at) FROM scored_rows) - INTERVAL {365 * 24} HOUR""")
_COLS = "build_id, " + ", ".join(NAMES) + ", label"
_REAL = "build_id, " + ", ".join("NULL AS char_density" if n == "char_density" else n for n in NAMES) + ", 'normal' AS label"
twin("weighted_training_union", "feature_rows", f"""
SELECT * FROM (SELECT {_COLS} FROM feature_rows WHERE label = 'normal' ORDER BY md5(build_id), build_id LIMIT 400)
UNION ALL SELECT {_REAL} FROM feature_rows, range(50) WHERE label = 'anomaly' AND suspicious_pattern_count > 0 AND log_line_count > 0
UNION ALL SELECT {_COLS} FROM feature_rows WHERE base64_pattern_count > 3""")

# ------------------------------------------------------------------ evaluation

_Y = "judged AS (SELECT *, CASE WHEN label = 'normal' THEN 1 ELSE -1 END AS y FROM scored_rows)"
_PERCENT = "CAST(concat('0x', left(md5(build_id), 8)) AS BIGINT) % 100"
_COUNTS = """count(*) FILTER (y = -1 AND prediction = -1) AS tp, count(*) FILTER (y = 1 AND prediction = -1) AS fp,
  count(*) FILTER (y = -1 AND prediction = 1) AS fn, count(*) FILTER (y = 1 AND prediction = 1) AS tn"""


def _share(top: str, bottom: str, digits: int = 6) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE round({top} / ({bottom}), {digits}) END::DOUBLE"


twin("prepare_labels", "scored_rows", """
SELECT build_id, CASE WHEN label = 'normal' THEN 1 ELSE -1 END AS y_label, prediction AS y_flag, 1 AS y_none FROM scored_rows""")
twin("train_test_split", "feature_rows", f"SELECT build_id, {_PERCENT} < 80 AS is_train FROM feature_rows")
twin("threshold_detector", "feature_rows", """
SELECT build_id, CASE WHEN duration_seconds > 600 OR suspicious_pattern_count >= 1 OR external_ip_count >= 1 OR base64_pattern_count >= 1
  THEN -1 ELSE 1 END AS prediction FROM feature_rows""")
twin("classification_metrics", "scored_rows", f"""
WITH {_Y}, c AS (SELECT {_COUNTS} FROM judged)
SELECT *, {_share('(tp + tn)', '(tp + tn + fp + fn)')} AS accuracy, {_share('tp', '(tp + fp)')} AS precision, {_share('tp', '(tp + fn)')} AS recall,
  {_share('2 * tp', '(2 * tp + fp + fn)')} AS f1, {_share('fp', '(fp + tn)')} AS false_positive_rate, {_share('fn', '(fn + tp)')} AS false_negative_rate FROM c""")
twin("confusion_matrix", "scored_rows", f"""
WITH {_Y}, c AS (SELECT {_COUNTS} FROM judged)
SELECT actual, predicted, n, round(n * 100.0::DOUBLE / (tp + fp + fn + tn), 4) AS percent, {_share('fp', '(fp + tn)')} AS false_positive_rate,
  {_share('fn', '(fn + tp)')} AS false_negative_rate
FROM c, (SELECT unnest(['normal', 'normal', 'anomaly', 'anomaly']) AS actual, unnest(['normal', 'anomaly', 'normal', 'anomaly']) AS predicted,
         unnest((SELECT [tn, fp, fn, tp] FROM c)) AS n)""")
twin("roc_auc", "scored_rows", f"""
WITH {_Y}, s AS (SELECT y, -anomaly_score AS s FROM judged),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM s)
SELECT round((sum(r) FILTER (y = -1) - count(*) FILTER (y = -1) * (count(*) FILTER (y = -1) + 1) / 2)
  / (count(*) FILTER (y = -1) * count(*) FILTER (y = 1)), 6) AS auc_roc FROM r""")
_BOUNDS = " UNION ALL ".join(
    f"SELECT {c}::DOUBLE AS contamination, (SELECT quantile_cont(anomaly_score, {c}) FROM split WHERE is_train AND y = 1) AS bound"
    for c in rules.CONTAMINATION_SWEEP)
twin("contamination_sweep", "scored_rows", f"""
WITH {_Y}, split AS (SELECT *, {_PERCENT} < 80 AS is_train FROM judged), bounds AS ({_BOUNDS}),
p AS (SELECT contamination, y, CASE WHEN anomaly_score < bound THEN -1 ELSE 1 END AS prediction FROM split, bounds WHERE NOT is_train),
c AS (SELECT contamination, {_COUNTS} FROM p GROUP BY contamination)
SELECT contamination, {_share('tp', '(tp + fp)')} AS precision, {_share('tp', '(tp + fn)')} AS recall, {_share('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM c""")
twin("stratified_kfold", "feature_rows", """
WITH l AS (SELECT build_id, CASE WHEN label = 'normal' THEN 1 ELSE -1 END AS y FROM feature_rows)
SELECT build_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(build_id), build_id) - 1) % 5 AS INTEGER) AS fold FROM l""")
_PROFILE = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count({n}) AS n, round(avg({n}), 4)::DOUBLE AS mean, round(stddev_samp({n}), 4)::DOUBLE AS std, round(min({n}), 4)::DOUBLE AS min, "
    f"round(max({n}), 4)::DOUBLE AS max, round(quantile_cont({n}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({n}::DOUBLE, 0.75), 4) AS p75 FROM feature_rows WHERE label = 'normal'"
    for n in NAMES)
twin("baseline_profile", "feature_rows", _PROFILE)
twin("label_counts", "feature_rows", "SELECT label, count(*) AS count FROM feature_rows GROUP BY label")
_DEV = " UNION ALL ".join(
    f"SELECT build_id, {i} AS idx, '{n}' AS feature, {n}::DOUBLE AS value, s.mean_{n} AS mean, CASE WHEN s.std_{n} > 0 THEN ({n}::DOUBLE - s.mean_{n}) / s.std_{n} ELSE 0 END AS z "
    f"FROM feature_rows, stats s" for i, n in enumerate(NAMES))
twin("deviation_report", "feature_rows", f"""
WITH normals AS (SELECT * FROM feature_rows WHERE label = 'normal'), {_STATS.format('normals')}, d AS ({_DEV}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY build_id ORDER BY abs(z) DESC, idx) AS INTEGER) AS rank FROM d)
SELECT build_id, rank, feature, round(value, 2) AS value, round(mean, 2)::DOUBLE AS mean, round(z, 2)::DOUBLE AS z_score, abs(z) > 2 AS flagged,
  CASE WHEN z > 0 THEN 'higher' ELSE 'lower' END AS direction FROM r WHERE rank <= 3""")
twin("flag_summary", "build_results", """
SELECT count(*) FILTER (is_anomaly) AS anomalies, count(*) AS total, bool_and(is_anomaly) AS all_flagged FROM build_results""")

# --------------------------------------------------------------------- serving

_LAST = "(SELECT max(created_at) FROM build_results)"
twin("results_page", "build_results", f"""
SELECT id, build_id, created_at, is_anomaly, anomaly_score, prediction, confidence, model_version FROM build_results
WHERE is_anomaly AND created_at >= {_LAST} - INTERVAL 20 DAY AND created_at <= {_LAST} - INTERVAL 1 DAY ORDER BY created_at DESC, id DESC LIMIT 100""")
twin("stored_results_served", "scored_rows", """
SELECT build_id, created_at, prediction = -1 OR suspicious_pattern_count >= 1 AS is_anomaly,
  round(CASE WHEN suspicious_pattern_count >= 1 AND anomaly_score > 0 THEN -0.05 ELSE anomaly_score END, 6)::DOUBLE AS anomaly_score, prediction FROM scored_rows""")
twin("latest_result_by_build", "build_results", """
SELECT build_id, created_at, id, is_anomaly, prediction, model_version,
  round(anomaly_score, 9) AS anomaly_score, round(confidence, 9) AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY created_at DESC, id DESC) AS k FROM build_results) WHERE k = 1""")
ORACLE_STATS = f"""
SELECT 168 AS period_hours, count(*) AS total_builds, count(*) FILTER (is_anomaly) AS total_anomalies,
  round(coalesce(count(*) FILTER (is_anomaly) / nullif(count(*), 0), 0), 12) AS anomaly_rate, round(coalesce(avg(anomaly_score), 0), 12) AS avg_score,
  round(coalesce(min(anomaly_score), 0), 12) AS min_score, round(coalesce(max(anomaly_score), 0), 12) AS max_score, round(coalesce(avg(confidence), 0), 12) AS avg_confidence
FROM build_results WHERE created_at > {_LAST} - INTERVAL 168 HOUR"""
twin("anomaly_stats", "build_results", ORACLE_STATS)
_SERIES = """SELECT time_bucket(INTERVAL {0}, created_at) AS time, count(*) AS total_builds, count(*) FILTER (is_anomaly) AS anomalies,
  round(coalesce(avg(anomaly_score), 0), 12) AS avg_score{2} FROM build_results {1} GROUP BY 1"""
twin("anomaly_timeseries", "build_results", _SERIES.format("1 HOUR", f"WHERE created_at > {_LAST} - INTERVAL 20 DAY", ""))
twin("anomaly_timeseries_weekly", "build_results", _SERIES.format("14 DAY", f"WHERE created_at > {_LAST} - INTERVAL 25 DAY", ""))
twin("normal_vs_anomaly_series", "build_results", _SERIES.format("1 DAY", "", ", count(*) - count(*) FILTER (is_anomaly) AS normal_builds"))
twin("stream_timeseries", "build_results", _SERIES.format("1 HOUR", "", ""))
twin("stream_anomaly_stats", "build_results", ORACLE_STATS)
twin("stream_counters", "build_results", """
SELECT 'waiting' AS step, count(*) FILTER (id % 10 <> 0) AS processed_total, count(*) FILTER (is_anomaly AND id % 10 <> 0) AS anomalies_detected,
  count(*) FILTER (id % 10 = 0) AS backlog FROM build_results
UNION ALL SELECT 'done', count(*), count(*) FILTER (is_anomaly), 0 FROM build_results""")
twin("audit_stats", "deliveries", f"""
SELECT count(*) AS total, count(*) FILTER ({_PROCESSED}) AS processed, count(*) FILTER (NOT {_PROCESSED}) AS pending FROM deliveries""")
twin("recent_raw_logs", "deliveries", "SELECT delivery_id, received_at, provider FROM deliveries ORDER BY received_at DESC, delivery_id DESC LIMIT 10")
twin("score_band", "build_results", """
SELECT CASE WHEN anomaly_score < -0.1 THEN 'Strong deviation from normal behavior' WHEN anomaly_score < 0 THEN 'Slight deviation detected'
  ELSE 'Within normal parameters' END AS band, count(*) AS n, count(*) FILTER (is_anomaly) AS anomalies,
  round(count(*) FILTER (is_anomaly) / count(*) * 100, 1) AS anomaly_rate_pct FROM build_results GROUP BY 1""")
_AXES = " UNION ALL ".join(
    f"SELECT build_id, {i} AS axis, '{n.replace('_', ' ')}' AS feature, round(least({n}::DOUBLE, 100), 4) AS value FROM feature_rows"
    for i, n in enumerate(NAMES[:6]))
twin("radar_features", "feature_rows", f"SELECT *, 100 AS full_mark, round(least(value / 10 * 20, 100), 4)::DOUBLE AS bar FROM ({_AXES})")

# ------------------------------------------- twins that need no model arithmetic

_KNOWN = ("duration_seconds", "char_density", "error_count")
twin("align_features", "feature_rows_missing", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {str(n in _KNOWN).lower()} AS in_training, true AS in_model, {f'count({n})' if n in _KNOWN else '0 * count(*)'} AS n_values FROM feature_rows_missing"
    for n in NAMES))
twin("model_versions", "feature_rows", """
SELECT '1.0.0' AS version, '2024-01-30T00:00:00' AS trained_at, count(*) AS n_samples FROM feature_rows, range(2) WHERE label = 'normal' GROUP BY range
UNION ALL SELECT '1.1.0', '2024-01-31T00:00:00', count(*) FROM feature_rows""")
twin("process_pending", "deliveries", f"""
WITH ordered AS (SELECT *, row_number() OVER (ORDER BY received_at, delivery_id) - 1 AS k, count(*) OVER () AS d FROM deliveries),
calls AS (SELECT CAST(k // (d // 3 + 1) + 1 AS INTEGER) AS call, count(*) AS handled, count(*) FILTER ({OK}) AS builds, any_value(d) AS d FROM ordered GROUP BY 1)
SELECT call, handled, CAST(d - sum(handled) OVER (ORDER BY call) AS BIGINT) AS pending, builds FROM calls
UNION ALL SELECT k, 0, 0, 0 FROM (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS k) WHERE k NOT IN (SELECT call FROM calls)""")
_STREAMED = f"""CASE shape WHEN 2 THEN concat(raw_logs, chr(10), 'one', chr(10), 'two 2') WHEN 5 THEN '' ELSE raw_logs END"""
twin("stream_features", "delivery_parts", f"""
WITH {_SHAPES}, texts AS (SELECT *, {_STREAMED} AS t FROM shapes),
keyed AS (SELECT CAST(delivery_id AS VARCHAR) AS build_id, t AS raw_logs FROM texts),
{_PER_BUILD.replace('all_logs', 'keyed')}
SELECT CASE WHEN shape IN (0, 1, 2, 4) THEN CAST(build_no AS VARCHAR) ELSE 'unknown' END AS build_id, repo_name,
  CAST(CASE shape WHEN 0 THEN floor(duration_seconds) WHEN 1 THEN CAST(floor(duration_seconds) AS BIGINT) % 200
       WHEN 2 THEN {_SECONDS} WHEN 4 THEN {_SECONDS} ELSE 0 END AS DOUBLE) AS duration_seconds,
  CAST({_MEASURES['log_line_count']} AS BIGINT) AS log_line_count, CAST({_MEASURES['char_density']} AS DOUBLE) AS char_density,
  CAST({_MEASURES['error_count']} AS BIGINT) AS error_count, CAST({_MEASURES['warning_count']} AS BIGINT) AS warning_count,
  unique_templates, template_entropy, CAST({matches('t', rules.SUSPICIOUS_PATTERNS)} AS BIGINT) AS suspicious_patterns,
  CAST({_PUBLIC_IPS.format('t')} AS BIGINT) AS external_ips, CAST(len({_untrusted_urls('t')}) AS BIGINT) AS external_urls, created_at
FROM texts x JOIN entropy e ON e.build_id = CAST(x.delivery_id AS VARCHAR)""")
