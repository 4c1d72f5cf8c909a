"""Registered queries: alert rules (§2.5)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vigil.operators import rules as ru
from vigil.plans.fixture_sql import with_views
from vigil.plans.q_series import _LOOKUP, END, T0, _rate_sql
from vigil.plans.registry import query
from vigil.sources import fixtures as fx

TICK = 15_000_000


def candidate_rules(spark, d):
    """A large rule table to screen, derived from every event (each trap of the screen occurs)."""
    b = fx.events_base(spark, d)
    k = F.col("k")
    name = (F.when(k % 11 == 0, F.lit("")).when(k % 11 == 1, F.repeat(F.lit("x"), 129))
            .otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit("-"), F.col("event_id").cast("string"), F.lit(" "))))
    expr = (F.when(k % 13 == 0, F.lit("  "))
            .when(k % 13 == 1, F.concat(F.lit("max_over_time(cpu_usage_percent[5m:1m]) > "), k.cast("string")))
            .when(k % 13 == 2, F.concat(F.lit("SCRAPE_INTERVAL > "), k.cast("string")))
            .when(k % 13 == 3, F.repeat(F.lit("a"), 2049))
            .when(k % 13 == 4, F.concat(F.lit("rate(x[5m]) > 1 and y[1m] > "), k.cast("string")))
            .otherwise(F.concat(F.lit("cpu_usage_percent{instance=\""), F.col("instance"), F.lit("\"} > "),
                                k.cast("string"))))
    durations = F.array(*[F.lit(x) for x in ["", "2m", "1h30m", "5ms", "0m", "1h0m", "m"]])
    sev = F.array(*[F.lit(x) for x in ["", "critical", "warning", "info", "fatal"]])
    summary = F.when(k % 17 == 0, F.repeat(F.lit("s"), 513)).otherwise(F.concat(F.lit("summary "), F.col("instance")))
    return b.select(F.col("event_id").alias("id"), name.alias("name"), expr.alias("expr"),
                    F.element_at(durations, (k % 7 + 1).cast("int")).alias("duration"),
                    F.element_at(sev, (k % 5 + 1).cast("int")).alias("severity"),
                    summary.alias("summary"), F.lit(" d ").alias("description"),
                    F.when(k % 3 == 0, F.lit(None)).otherwise(k % 2 == 0).alias("enabled"))


_CAND = with_views("base") + """,
cand AS (SELECT event_id AS id,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 11 = 1 THEN repeat('x', 129) ELSE ' ' || event_type || '-' || CAST(event_id AS VARCHAR) || ' ' END AS name,
  CASE WHEN k % 13 = 0 THEN '  ' WHEN k % 13 = 1 THEN 'max_over_time(cpu_usage_percent[5m:1m]) > ' || CAST(k AS VARCHAR)
       WHEN k % 13 = 2 THEN 'SCRAPE_INTERVAL > ' || CAST(k AS VARCHAR) WHEN k % 13 = 3 THEN repeat('a', 2049)
       WHEN k % 13 = 4 THEN 'rate(x[5m]) > 1 and y[1m] > ' || CAST(k AS VARCHAR)
       ELSE 'cpu_usage_percent{instance="' || instance || '"} > ' || CAST(k AS VARCHAR) END AS expr,
  (['', '2m', '1h30m', '5ms', '0m', '1h0m', 'm'])[k % 7 + 1] AS duration,
  (['', 'critical', 'warning', 'info', 'fatal'])[k % 5 + 1] AS severity,
  CASE WHEN k % 17 = 0 THEN repeat('s', 513) ELSE 'summary ' || instance END AS summary,
  ' d ' AS description, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 2 = 0 END AS enabled
FROM base)"""


@query("rules_enabled", _CAND + """
SELECT id FROM cand WHERE coalesce(enabled, true)""")
def q_rules_enabled(spark, d):
    return ru.rules_enabled(candidate_rules(spark, d)).select("id")


@query("rules_validate", _CAND + """,
n AS (SELECT id, trim(coalesce(name, '')) AS name, trim(coalesce(expr, '')) AS expr,
             coalesce(nullif(trim(coalesce(duration, '')), ''), '2m') AS duration,
             coalesce(nullif(trim(coalesce(severity, '')), ''), 'warning') AS severity,
             trim(coalesce(summary, '')) AS summary, coalesce(enabled, true) AS enabled FROM cand)
SELECT id, name, duration, severity, enabled,
  CASE WHEN strlen(name) = 0 OR strlen(name) > 128 THEN 'name must be 1-128 characters'
       WHEN strlen(expr) = 0 THEN 'expr is required'
       WHEN strlen(expr) > 2048 THEN 'expr too long'
       WHEN contains(lower(expr), 'admin_api') OR contains(lower(expr), 'scrape_interval')
            OR contains(lower(expr), 'scrape_duration') THEN 'expr contains forbidden reference'
       WHEN regexp_matches(expr, '\\[[^\\]]*:[^\\]]*\\]') THEN 'expr subquery is not allowed'
       WHEN NOT regexp_full_match(duration, '(?:[0-9]*[1-9][0-9]*(?:ms|[smhdwy]))+')
            THEN 'duration must be a positive prometheus duration'
       WHEN severity NOT IN ('critical', 'warning', 'info') THEN 'invalid severity'
       WHEN strlen(summary) > 512 THEN 'summary must be at most 512 characters' END AS reason
FROM n""")
def q_rules_validate(spark, d):
    v = ru.rules_validate(candidate_rules(spark, d))
    return v.select("id", "name", "duration", "severity", "enabled", "reason")


_EVAL = (with_views("samples", "rules")
         + f", ticks AS (SELECT unnest(range({T0}, {END} + 1, {TICK})) AS eval_us), "
         "sel AS (SELECT * FROM samples WHERE metric IN (SELECT metric FROM rules)), "
         f"lk AS ({_LOOKUP.format(src='sel')})" + """,
ev AS (SELECT r.id AS rule_id, r.name AS rule, lk.series, lk.labels, lk.eval_us, lk.value,
              CASE r.cmp WHEN '>' THEN lk.value > r.threshold WHEN '==' THEN lk.value = r.threshold END AS is_true
       FROM lk JOIN rules r ON r.metric = lk.metric AND (r.job = '' OR contains(lk.labels, 'job=' || r.job))),
t AS (SELECT ev.*, r.for_ms, r.severity FROM ev JOIN rules r ON r.id = ev.rule_id WHERE is_true),
i AS (SELECT *, eval_us // """ + str(TICK) + """ - row_number() OVER (PARTITION BY rule_id, series ORDER BY eval_us) AS isl
      FROM t),
st AS (SELECT *, min(eval_us) OVER (PARTITION BY rule_id, series, isl) AS active_since,
              CASE WHEN eval_us - min(eval_us) OVER (PARTITION BY rule_id, series, isl) >= for_ms * 1000
                   THEN 'firing' ELSE 'pending' END AS state FROM i)""")


def _states(spark, d):
    rules = fx.rules(spark)
    ev = ru.rule_eval(fx.samples(spark, d), rules, T0, END, "15s", windows=())
    return ev, ru.rule_for(ev, rules, "15s"), rules


@query("rule_eval", _EVAL + """
SELECT rule_id, series, eval_us, round(value, 6) AS value, is_true FROM ev""")
def q_rule_eval(spark, d):
    ev, _, _ = _states(spark, d)
    return ev.select("rule_id", "series", "eval_us", F.round("value", 6).alias("value"), "is_true")


@query("rule_for", _EVAL + """
SELECT rule_id, series, eval_us, active_since, state FROM st""")
def q_rule_for(spark, d):
    _, st, _ = _states(spark, d)
    return st.select("rule_id", "series", "eval_us", "active_since", "state")


@query("alerts_series", _EVAL + """,
f AS (SELECT rule AS alertname, severity, eval_us, regexp_extract(series, 'instance=([^,}]*)', 1) AS instance
      FROM st WHERE state = 'firing')
SELECT 'total' AS view, eval_us, '' AS key, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT 'severity', eval_us, severity, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 'alertname', eval_us, alertname || '/' || severity, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 'instance', eval_us, instance, count(*) FROM f GROUP BY ALL""")
def q_alerts_series(spark, d):
    _, st, _ = _states(spark, d)
    return ru.alerts_counts(ru.alerts_series(st))


@query("rule_transitions", _EVAL + f""",
runs AS (SELECT rule_id, rule, series, active_since, min(eval_us) FILTER (WHERE state = 'firing') AS fired_us,
                max(eval_us) AS last_us, arg_max(value, eval_us) AS v, any_value(severity) AS severity,
                any_value(labels) AS labels
         FROM st GROUP BY rule_id, rule, series, active_since HAVING fired_us IS NOT NULL),
lab AS (SELECT *, array_to_string(list_sort(list_concat(string_split(labels, ','),
                   ['alertname=' || rule, 'severity=' || severity])), ',') AS lt,
               regexp_extract(labels, 'instance=([^,]*)', 1) AS inst FROM runs),
ev2 AS (SELECT md5(lt) AS fingerprint, 'firing' AS status, fired_us AS starts_us, NULL::BIGINT AS ends_us, rule,
               inst FROM lab
        UNION ALL
        SELECT md5(lt), 'resolved', fired_us, last_us + {TICK}, rule, inst FROM lab WHERE last_us + {TICK} <= {END})
SELECT fingerprint, status, starts_us, ends_us,
       CASE rule WHEN 'HighCPU' THEN 'High CPU usage on ' WHEN 'CriticalCPU' THEN 'Critical CPU usage on '
                 WHEN 'HighMemory' THEN 'High memory usage on ' WHEN 'HighDisk' THEN 'High disk usage on '
                 ELSE 'Host ' END || inst || CASE WHEN rule = 'HostDown' THEN ' is down' ELSE '' END AS summary
FROM ev2""")
def q_rule_transitions(spark, d):
    _, st, rules = _states(spark, d)
    t = ru.rule_transitions(st, rules, END, "15s")
    return t.select("fingerprint", "status", "starts_us", "ends_us",
                    F.element_at("annotations", F.lit("summary")).alias("summary"))


def _service_sql() -> str:
    """Error ratio and latency vectors on the minute grid, as ``ev``; runs and states as for the host rules."""
    from vigil.plans.q_hosts import _http_rate_sql, _quantile_sql

    views = _http_rate_sql().split(" ticks AS", 1)
    rates = with_views("http_counter", "http_buckets") + ", ticks AS" + views[1]
    quantile = _quantile_sql(0.95).rsplit("SELECT instance, eval_us, round", 1)[0].rstrip()
    for name in ("lagged", "st", "ex", "ex2", "rated"):  # the second rate family gets names of its own
        quantile = re.sub(rf"\b{name}\b", f"{name}_b", quantile)
    return rates + """,
er AS (SELECT instance, eval_us, sum(value) FILTER (WHERE regexp_extract(labels, 'status=([^,]*)', 1) LIKE '5__') AS e, sum(value) AS t
       FROM rated GROUP BY ALL)""" + quantile + """,
v AS (SELECT 6 AS rule_id, 'http_error_ratio{instance=' || instance || '}' AS series, eval_us, e / t AS value, 0.05 AS threshold,
             120000 AS for_ms FROM er WHERE e IS NOT NULL AND t > 0
      UNION ALL SELECT 7, 'http_p95_latency{instance=' || instance || '}', eval_us, value, 1.0, 300000 FROM q),
t1 AS (SELECT * FROM v WHERE value > threshold AND NOT isnan(value)),
isl AS (SELECT *, eval_us // 60000000 - row_number() OVER (PARTITION BY rule_id, series ORDER BY eval_us) AS i FROM t1),
sts AS (SELECT *, min(eval_us) OVER (PARTITION BY rule_id, series, i) AS active_since FROM isl)
SELECT rule_id, series, eval_us, active_since, round(value, 6) AS value,
       CASE WHEN eval_us - active_since >= for_ms * 1000 THEN 'firing' ELSE 'pending' END AS state FROM sts"""


@query("rule_service", _service_sql())
def q_rule_service(spark, d):
    """The two service rules: states over the derived error-ratio and latency vectors, minute ticks."""
    rules = fx.rules(spark, service=True).filter("id >= 6")
    samples = fx.gauges(spark, d).filter("metric in ('http_error_ratio', 'http_p95_latency')")
    ev = ru.rule_eval(samples, rules, T0, END, "1m", windows=(), vectors=fx.service_vectors(spark, d, T0, END, "1m"))
    st = ru.rule_for(ev, rules, "1m")
    return st.select(F.col("rule_id").cast("int"), "series", "eval_us", "active_since", F.round("value", 6).alias("value"), "state")


# A rule of our own on a rate: receiving bytes by host, over five minutes.
RATE_RULE = (8, "HighReceive", "network_recv_bytes_total", {"job": "probe"}, "rate", 300, "sum", ["instance"], ">", 400.0, 60_000, "info",
             "High traffic to {{ $labels.instance }}", "{{ $value }} bytes a second are received.", True, "sum by (instance) (rate(network_recv_bytes_total[5m])) > 400", "1m")


def _rate_rule_sql() -> str:
    views = with_views("samples") + f", ticks AS (SELECT unnest(range({T0}, {END} + 1, {TICK})) AS eval_us), sel AS (SELECT * FROM samples WHERE metric = 'network_recv_bytes_total'), "
    return views + _rate_sql("sel").strip() + """,
ev AS (SELECT instance, eval_us, sum(value) AS value FROM rated GROUP BY ALL),
t AS (SELECT *, eval_us // """ + str(TICK) + """ - row_number() OVER (PARTITION BY instance ORDER BY eval_us) AS isl FROM ev WHERE value > 400),
runs AS (SELECT instance, eval_us, min(eval_us) OVER (PARTITION BY instance, isl) AS active_since FROM t)
SELECT 8 AS rule_id, '{instance=' || instance || '}' AS series, eval_us, round(value, 4) AS value, value > 400 AS is_true, active_since,
       CASE WHEN eval_us - active_since >= 60000000 THEN 'firing' WHEN active_since IS NOT NULL THEN 'pending' END AS state
FROM ev LEFT JOIN runs USING (instance, eval_us)"""


@query("rule_rate", _rate_rule_sql())
def q_rule_rate(spark, d):
    """A rate rule, summed by a label that stays one: evaluation and states."""
    rules = spark.createDataFrame([RATE_RULE], fx.RULE_SCHEMA)
    ev = ru.rule_eval(fx.samples(spark, d), rules, T0, END, "15s", windows=(300,))
    st = ru.rule_for(ev, rules, "15s").select("series", "eval_us", "active_since", "state")
    return ev.join(st, ["series", "eval_us"], "left").select(F.col("rule_id").cast("int"), "series", "eval_us", F.round("value", 4).alias("value"), "is_true", "active_since", "state")
