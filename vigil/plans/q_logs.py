"""Registered queries: logs and traces (§2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import logs as lg
from vigil.operators import series as sr
from vigil.plans.fixture_sql import with_views
from vigil.plans.q_series import _GRID, _LOOKUP, END, R6, T0
from vigil.plans.registry import query
from vigil.sources import fixtures as fx


def _logs(spark, d):
    return fx.logs(spark, d)


# Boolean searches: (name, tree, SQL condition).
SEARCHES = [
    ("services", ("and", ("is", "service", "web", "alert"), ("is", "level", "error", "warn"), ("exists", "trace_id"), ("like", "msg", "*kafka*")),
     "service IN ('web', 'alert') AND level IN ('error', 'warn') AND trace_id IS NOT NULL AND lower(msg) LIKE '%kafka%'"),
    ("pipeline", ("or", ("is", "service", "probe"), ("like", "msg", "*kafka*", "*alert*")),
     "service = 'probe' OR lower(msg) LIKE '%kafka%' OR lower(msg) LIKE '%alert%'"),
    ("failures", ("and", ("exists", "error"), ("not", ("like", "error", "*timeout*", "*cookie*"))),
     "error IS NOT NULL AND NOT (lower(error) LIKE '%timeout%' OR lower(error) LIKE '%cookie%')"),
    ("collectors", ("and", ("exists", "collector"), ("is", "level", "error")), "collector IS NOT NULL AND level = 'error'"),
]


@query("log_search", with_views("logs") + "\n" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS search, event_id, t_us, service, level, msg FROM logs WHERE {sql}" for name, _, sql in SEARCHES))
def q_log_search(spark, d):
    out = None
    for name, tree, _ in SEARCHES:
        s = lg.log_search(_logs(spark, d), query=tree).select(F.lit(name).alias("search"), "event_id", "t_us", "service", "level", "msg")
        out = s if out is None else out.unionByName(s)
    return out


@query("log_volume", with_views("logs") + f""",
b AS (SELECT {T0} + i * 60000000 AS bucket_us FROM range(0, {(END - T0) // 60_000_000}) t(i)),
c AS (SELECT {T0} + (t_us - {T0}) // 60000000 * 60000000 AS bucket_us, count(*) AS n FROM logs
      WHERE t_us >= {T0} AND t_us < {END} GROUP BY ALL)
SELECT b.bucket_us, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM b LEFT JOIN c USING (bucket_us)""")
def q_log_volume(spark, d):
    return lg.log_volume(_logs(spark, d), "1m", T0, END)


@query("log_level_dist", with_views("logs") + f"""
SELECT {T0} + (t_us - {T0}) // 300000000 * 300000000 AS bucket_us, service, count(*) AS n,
       count(*) FILTER (WHERE level = 'error') AS n_error, count(*) FILTER (WHERE level = 'warn') AS n_warn,
       count(*) FILTER (WHERE level = 'info') AS n_info,
       round(count(*) FILTER (WHERE level = 'error') / count(*), 6) AS error_rate
FROM logs GROUP BY ALL""")
def q_log_level_dist(spark, d):
    r = lg.log_level_dist(_logs(spark, d), "5m", T0)
    return r.select("bucket_us", "service", "n", "n_error", "n_warn", "n_info", R6("error_rate").alias("error_rate"))


@query("http_access", with_views("logs") + """
SELECT path, status, count(*) AS n, count(*) FILTER (WHERE latency_ms > 1000) AS slow,
       count(*) FILTER (WHERE level = 'error') AS errors, round(avg(latency_ms), 6) AS avg_latency_ms,
       round(max(latency_ms), 6) AS max_latency_ms
FROM logs WHERE status IS NOT NULL GROUP BY ALL""")
def q_http_access(spark, d):
    r = lg.http_access(_logs(spark, d))
    return r.select("path", "status", "n", "slow", "errors", R6("avg_latency_ms").alias("avg_latency_ms"),
                    R6("max_latency_ms").alias("max_latency_ms"))


@query("http_latency", with_views("logs") + """,
u AS (SELECT path, status, CAST(round(latency_ms * 1000) AS BIGINT) AS us FROM logs WHERE status IS NOT NULL)
SELECT path, status, count(*) AS n, round(avg(us) / 1000, 6) AS mean_ms, round(quantile_cont(us, 0.5) / 1000, 6) AS p50_ms,
       round(quantile_cont(us, 0.95) / 1000, 6) AS p95_ms, round(quantile_cont(us, 0.99) / 1000, 6) AS p99_ms, round(max(us) / 1000, 6) AS max_ms
FROM u GROUP BY ALL""")
def q_http_latency(spark, d):
    r = lg.http_latency(_logs(spark, d))
    return r.select("path", "status", "n", *(R6(c).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")))


@query("collector_failures", with_views("logs") + """
SELECT collector, count(*) AS failures FROM logs WHERE collector IS NOT NULL AND level = 'error' GROUP BY ALL""")
def q_collector_failures(spark, d):
    return lg.collector_failures(_logs(spark, d))


@query("route_template", with_views("logs") + """
SELECT CASE WHEN regexp_full_match(path, '/api/v1/hosts/[^/]+/metrics') THEN '/api/v1/hosts/:instance/metrics'
            ELSE path END AS route, count(*) AS n FROM logs GROUP BY ALL""")
def q_route_template(spark, d):
    return lg.with_route_template(_logs(spark, d)).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


_RED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
  '([A-Za-z][A-Za-z0-9+.\-]*://[^:/@\s]+:)[^@\s]+(@)', '\1***\2', 'g'),
  '(?i)(authorization: (?:bearer )?).+', '\1***', 'g'),
  '(?i)(cookie: ).+', '\1***', 'g'),
  '(?i)\b(password|token)(=)[^\s]+', '\1\2***', 'g')"""


@query("log_redact", with_views("logs") + f"""
SELECT event_id, {_RED.format(c='error')} AS error, {_RED.format(c='msg')} AS msg,
       coalesce({_RED.format(c='error')} <> error, false) OR coalesce({_RED.format(c='msg')} <> msg, false) AS redacted
FROM logs""")
def q_log_redact(spark, d):
    return lg.log_redact(_logs(spark, d)).select("event_id", "error", "msg", "redacted")


@query("log_trace_join", with_views("logs") + """
SELECT trace_id, count(DISTINCT span_id) AS spans, array_to_string(list_sort(list(DISTINCT service)), ',') AS services,
       min(t_us) AS start_us, max(t_us) AS end_us
FROM logs WHERE trace_id IS NOT NULL GROUP BY ALL""")
def q_log_trace_join(spark, d):
    t = lg.log_trace_join(_logs(spark, d))
    return t.select("trace_id", "spans", F.array_join("services", ",").alias("services"), "start_us", "end_us")


@query("log_span_join", with_views("logs") + """,
spans AS (SELECT trace_id, span_id AS span, max(t_us) - min(t_us) AS took_us FROM logs WHERE span_id IS NOT NULL AND event_id % 3 <> 0
          GROUP BY ALL)
SELECT l.trace_id, count(DISTINCT l.span_id) AS spans, min(l.t_us) AS start_us, max(l.t_us) AS end_us
FROM logs l JOIN spans s ON l.trace_id = s.trace_id GROUP BY ALL""")
def q_log_span_join(spark, d):
    """Logs joined to a span table by trace id: only traces with stored spans come back."""
    L = _logs(spark, d)
    spans = (L.filter(F.col("span_id").isNotNull() & (F.col("event_id") % 3 != 0)).groupBy("trace_id", F.col("span_id").alias("span"))
             .agg((F.max("t_us") - F.min("t_us")).alias("took_us")))
    return lg.log_trace_join(L, spans).select("trace_id", "spans", "start_us", "end_us")


@query("trace_rate", with_views("logs") + f"""
SELECT {T0} + (t_us - {T0}) // 300000000 * 300000000 AS bucket_us, count(DISTINCT trace_id) AS traces
FROM logs WHERE trace_id IS NOT NULL GROUP BY ALL""")
def q_trace_rate(spark, d):
    return lg.trace_rate(_logs(spark, d), "5m", T0)


@query("trace_latency", with_views("logs") + """,
t AS (SELECT trace_id, (max(t_us) - min(t_us)) / 1000.0 AS d FROM logs WHERE trace_id IS NOT NULL GROUP BY ALL)
SELECT count(*) AS traces, round(avg(d), 6) AS mean_ms, round(quantile_cont(d, 0.5), 6) AS p50_ms,
       round(quantile_cont(d, 0.95), 6) AS p95_ms, round(max(d), 6) AS max_ms FROM t""")
def q_trace_latency(spark, d):
    r = lg.trace_latency(_logs(spark, d))
    return r.select("traces", R6("mean_ms").alias("mean_ms"), R6("p50_ms").alias("p50_ms"),
                    R6("p95_ms").alias("p95_ms"), R6("max_ms").alias("max_ms"))


@query("trace_sample", with_views("logs") + f"""
SELECT event_id, trace_id FROM logs
WHERE trace_id IS NOT NULL AND (('0x' || substr(trace_id, 17, 16))::UBIGINT >> 1) < {int(0.25 * (1 << 63))}""")
def q_trace_sample(spark, d):
    return lg.trace_sample(_logs(spark, d), 0.25).select("event_id", "trace_id")


@query("metric_log_correlate", with_views("samples", "logs") + f", {_GRID}, "
       "sel AS (SELECT * FROM samples WHERE metric = 'cpu_usage_percent'), "
       f"lk AS ({_LOOKUP.format(src='sel')})" + """
SELECT lk.instance, lk.eval_us AS point_us, round(lk.value, 6) AS point_value, l.event_id, l.t_us
FROM lk JOIN logs l ON l.instance = lk.instance AND l.t_us BETWEEN lk.eval_us - 30000000 AND lk.eval_us + 30000000
WHERE lk.value > 90""")
def q_metric_log_correlate(spark, d):
    s = fx.samples(spark, d)
    v = sr.compare_filter(sr.range_vector_grid(sr.select_series(s, "cpu_usage_percent"), T0, END, "1m"), ">", 90)
    j = lg.metric_log_correlate(v, _logs(spark, d), "30s")
    return j.select("instance", "point_us", R6("point_value").alias("point_value"), "event_id", "t_us")


@query("ratelimit_audit", with_views("requests") + """,
r AS (SELECT * REPLACE (CASE WHEN regexp_full_match(route, '/api/v1/hosts/[^/]+/metrics') THEN '/api/v1/hosts/:instance/metrics'
                             ELSE route END AS route) FROM requests WHERE route NOT IN ('/metrics', '/healthz', '/readyz')
        AND (starts_with(route, '/api/') OR starts_with(route, '/ws/'))),
c AS (SELECT event_id,
             count(*) OVER (PARTITION BY client_ip, route ORDER BY t_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)
             - count(*) OVER (PARTITION BY client_ip, route, t_us ORDER BY event_id
                              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS used FROM r)
SELECT event_id, used, used <= 3 AS allowed, CAST(greatest(3 - used, 0) AS BIGINT) AS remaining FROM c""")
def q_ratelimit_audit(spark, d):
    r = lg.ratelimit_audit(fx.requests(spark, d), limit=3)
    return r.select("event_id", "used", "allowed", "remaining")


@query("log_keyword", with_views("logs") + """
SELECT event_id, CASE WHEN length(error) <= 256 THEN error END AS error_keyword FROM logs WHERE error IS NOT NULL""")
def q_log_keyword(spark, d):
    k = lg.log_keyword(_logs(spark, d).filter(F.col("error").isNotNull()), ["error"])
    return k.select("event_id", "error_keyword")
