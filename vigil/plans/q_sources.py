"""Registered queries: sources, sinks and retention (§2.1).

Each reader is exercised on wire-format text that Spark derives from the fixture tables
(so the work grows with them), then checked against the values DuckDB derives directly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.functions.labels import label_text
from vigil.operators import series as sr
from vigil.plans.fixture_sql import with_views
from vigil.plans.q_alerts import _alerts
from vigil.plans.q_series import _GRID, _LOOKUP, END, R6, T0
from vigil.plans.registry import query
from vigil.session import checkpoint_dir
from vigil.sources import fixtures as fx
from vigil.sources import parsers as ps
from vigil.sources import sinks as sk


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ query API responses

def query_responses(spark, d):
    """One matrix response per cpu series over the 1m grid; hosts ending in 7 get an error, and
    those ending in 3 a value that is no number in every fifth minute."""
    g = sr.range_vector_grid(sr.select_series(fx.samples(spark, d), "cpu_usage_percent"), T0, END, "1m")
    pts = g.groupBy("series", "instance").agg(
        F.first("labels").alias("labels"),
        F.array_sort(F.collect_list(F.struct("eval_us", "value"))).alias("_p"))
    odd = F.col("instance").endswith("3")
    values = F.transform("_p", lambda p: F.array(
        (p["eval_us"].cast("decimal(20,0)") / 1_000_000).cast("string"),
        F.when(odd & (F.floor(p["eval_us"] / 60_000_000) % 5 == 0), F.lit("bad")).otherwise(p["value"].cast("string"))))
    metric = F.map_concat(F.create_map(F.lit("__name__"), F.lit("cpu_usage_percent")), F.col("labels"))
    ok = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(
        F.lit("matrix").alias("resultType"),
        F.array(F.struct(metric.alias("metric"), values.alias("values"))).alias("result")).alias("data")))
    err = F.to_json(F.struct(F.lit("error").alias("status"), F.lit("query timed out").alias("error")))
    return pts.select("series", F.when(F.col("instance").endswith("7"), err).otherwise(ok).alias("body"))


@query("src_query_response", with_views("samples") + f", {_GRID}, sel AS (SELECT * FROM samples WHERE metric = "
       f"'cpu_usage_percent'), lk AS ({_LOOKUP.format(src='sel')})" + """
SELECT 'cpu_usage_percent' AS metric, instance, CASE WHEN NOT odd THEN eval_us END AS t_us, CASE WHEN NOT odd THEN round(value, 6) END AS value,
       CASE WHEN odd THEN 'invalid point' END AS error
FROM (SELECT *, ends_with(instance, '3') AND eval_us // 60000000 % 5 = 0 AS odd FROM lk) WHERE NOT ends_with(instance, '7')
UNION ALL
SELECT NULL, NULL, NULL::BIGINT, NULL::DOUBLE, 'query failed: query timed out'
FROM (SELECT DISTINCT instance FROM lk WHERE ends_with(instance, '7'))""")
def q_src_query_response(spark, d):
    r = ps.src_query_response(query_responses(spark, d))
    return r.select("metric", "instance", "t_us", R6("value").alias("value"), "error")


# ------------------------------------------------------------------ exposition text

def exposition_lines(spark, d):
    s = fx.gauges(spark, d)
    own = F.map_filter("labels", lambda k, v: ~k.isin("instance", "job"))
    lab = F.array_join(F.transform(F.array_sort(F.map_entries(own)),
                                   lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    lab = F.when(F.col("event_id") % 71 == 0, F.concat_ws(",", F.lit('job="own"'), F.nullif(lab, F.lit("")))).otherwise(lab)
    line = F.concat(F.col("metric"), F.when(lab != "", F.concat(F.lit("{"), lab, F.lit("}"))).otherwise(F.lit("")),
                    F.lit(" "), F.col("value").cast("string"))
    samples = s.select(line.alias("value"), "t_us", "instance", F.lit("probe").alias("job"))
    bad = s.select(F.explode(F.array(
        F.when(F.col("event_id") % 61 == 0, F.concat(F.col("metric"), F.lit(" not-a-number"))),
        F.when(F.col("event_id") % 67 == 0, F.concat(F.col("metric"), F.lit('{a="1",a="2"} 5'))))).alias("value"),
        "t_us", "instance", F.lit("probe").alias("job")).filter("value is not null")
    samples = samples.unionByName(bad)
    comments = s.select(F.concat(F.lit("# TYPE "), F.col("metric"), F.lit(" gauge")).alias("value"), "t_us",
                        "instance", F.lit("probe").alias("job")).dropDuplicates(["value", "instance"])
    return samples.unionByName(comments)


@query("src_exposition", with_views("samples") + """
SELECT CASE WHEN event_id % 71 = 0 THEN replace(series, '{', '{exported_job=own,') ELSE series END AS series, t_us,
       round(value, 6) AS value FROM samples WHERE metric <> 'network_recv_bytes_total'""")
def q_src_exposition(spark, d):
    e = ps.src_exposition(exposition_lines(spark, d))
    return e.select("series", "t_us", R6("value").alias("value"))


# ------------------------------------------------------------------ webhook envelopes

def webhook_bodies(spark, d):
    a = _alerts(spark, d)
    a = (a.withColumn("status", F.when(F.col("event_id") % 53 == 0, F.lit("pending")).otherwise(F.col("status")))
         .withColumn("fingerprint", F.when((F.col("event_id") % 59 == 0) & (F.col("event_id") % 53 != 0), F.lit(""))
                     .otherwise(F.col("fingerprint"))))
    rec = F.struct(F.col("status"), F.col("labels"), F.col("annotations"),
                   F.when(F.col("event_id") % 61 == 0, F.lit("12:00")).otherwise(ps.us_to_rfc3339(F.col("starts_us"))).alias("startsAt"),
                   ps.us_to_rfc3339(F.col("ends_us")).alias("endsAt"), F.lit("").alias("generatorURL"),
                   F.col("fingerprint"))
    g = a.groupBy("alertname", "instance", (F.col("received_us") / 60_000_000).cast("bigint").alias("_m")).agg(
        F.min("received_us").alias("received_us"), F.collect_list(rec).alias("alerts"))
    body = F.to_json(F.struct(F.lit("webhook").alias("receiver"), F.lit("firing").alias("status"), F.col("alerts"),
                              F.create_map(F.lit("alertname"), F.col("alertname")).alias("groupLabels")))
    return g.select(body.alias("body"), "received_us")


@query("src_webhook", with_views("alerts") + """,
a AS (SELECT *, CASE WHEN event_id % 53 = 0 THEN 'pending' ELSE status END AS st,
             CASE WHEN event_id % 59 = 0 AND event_id % 53 <> 0 THEN '' ELSE fingerprint END AS fp,
             received_us // 60000000 AS m FROM alerts),
env AS (SELECT alertname, instance, m, min(received_us) AS rcv,
               bool_or((fp <> '' AND st NOT IN ('firing', 'resolved')) OR event_id % 61 = 0) AS bad FROM a GROUP BY ALL)
SELECT a.fp AS fingerprint, a.st AS status, a.alertname, a.starts_us, a.ends_us, env.rcv AS received_us
FROM a JOIN env USING (alertname, instance, m) WHERE NOT env.bad AND a.fp <> ''""")
def q_src_webhook(spark, d):
    w = ps.src_webhook(webhook_bodies(spark, d))
    return w.select("fingerprint", "status", F.element_at("labels", F.lit("alertname")).alias("alertname"),
                    "starts_us", "ends_us", "received_us")


# ------------------------------------------------------------------ alert-event topic

def event_messages(spark, d):
    """Alert events as JSON messages; some are cut short, have a time that is none, labels of another
    type, no fingerprint (the message key is one) or a bad status."""
    a, e = _alerts(spark, d), F.col("event_id")
    msg = F.struct(F.lit("alert").alias("type"), F.when(e % 59 != 0, F.col("fingerprint")).alias("fingerprint"),
                   F.when(e % 61 == 0, F.lit("pending")).otherwise(F.col("status")).alias("status"), "labels", "annotations",
                   F.when(e % 43 == 0, F.lit("not-a-time")).otherwise(ps.us_to_rfc3339(F.col("starts_us"))).alias("startsAt"),
                   ps.us_to_rfc3339(F.col("ends_us")).alias("endsAt"), F.lit("").alias("generatorURL"),
                   F.when(e % 67 == 0, F.lit("12:00")).otherwise(ps.us_to_rfc3339(F.col("received_us"))).alias("receivedAt"))
    kv = a.select("event_id", F.col("fingerprint").alias("key"), F.to_json(msg).alias("value"))
    wrong_type = F.regexp_replace("value", r'"labels":\{[^}]*\}', '"labels":"x"')
    return kv.withColumn("value", F.when(e % 41 == 0, F.substring("value", 1, 25)).when(e % 47 == 0, wrong_type)
                         .otherwise(F.col("value")))


_OUTCOME_CTE = """,
m AS (SELECT *, event_id % 41 = 0 OR event_id % 43 = 0 OR event_id % 47 = 0 OR event_id % 67 = 0 AS broken,
             event_id % 59 = 0 AS no_fp, event_id % 61 = 0 AS no_st FROM alerts),
o AS (SELECT *, CASE WHEN broken THEN 'invalid_json' WHEN no_fp OR no_st THEN 'permanent_error' ELSE 'processed' END AS outcome FROM m)"""
_EVENTS_SQL = with_views("alerts") + _OUTCOME_CTE + """
SELECT event_id, CASE WHEN NOT broken AND NOT no_fp THEN fingerprint END AS fingerprint,
       CASE WHEN NOT broken THEN CASE WHEN no_st THEN 'pending' ELSE status END END AS status,
       CASE WHEN NOT broken THEN starts_us END AS starts_us, CASE WHEN NOT broken THEN ends_us END AS ends_us,
       CASE WHEN NOT broken THEN received_us END AS received_us, outcome FROM o"""


@query("src_alert_events", _EVENTS_SQL)
def q_src_alert_events(spark, d):
    p = ps.parse_alert_events(event_messages(spark, d))
    return p.select("event_id", "fingerprint", "status", "starts_us", "ends_us", "received_us", "outcome")


@query("sink_alert_events", with_views("alerts") + """
SELECT fingerprint, status, starts_us, ends_us, received_us, 'processed' AS outcome FROM alerts""")
def q_sink_alert_events(spark, d):
    """Publish to the (file) topic, read it back with the topic reader."""
    path = _scratch(spark, "alert-topic")
    sk.sink_alert_events(_alerts(spark, d), path=path)
    r = ps.src_alert_events(spark, path=path)
    return r.select("fingerprint", "status", "starts_us", "ends_us", "received_us", "outcome")


# ------------------------------------------------------------------ container logs

def _inner_json(L):
    extra = F.when(F.col("k") % 5 == 0, F.col("path"))
    odd = F.col("event_id") % 47 == 0  # a time that is none, and text for numbers

    def or_text(c, text):
        return F.when(odd, F.lit(text)).otherwise(c.cast("string"))

    return F.to_json(F.struct(
        or_text(ps.us_to_rfc3339(F.col("t_us")), "12:00").alias("ts"), "level", "msg", "service", "instance", "trace_id", "span_id",
        "request_id", "method", "path", or_text(F.col("status"), "abc").alias("status"),
        or_text(F.col("latency_ms"), "fast").alias("latency_ms"), "client_ip", "error", "collector",
        extra.alias("http.route")))


def _logs_k(spark, d):
    return fx.logs_of(fx.requests(spark, d), "k")


def docker_lines(spark, d):
    L = _logs_k(spark, d)
    inner = F.when(F.col("event_id") % 43 == 0, F.concat(F.lit("plain text "), F.col("event_id").cast("string"))) \
        .otherwise(_inner_json(L))
    outer = F.to_json(F.struct(F.concat(inner, F.lit("\n")).alias("log"), F.col("stream"),
                               ps.us_to_rfc3339(F.col("t_us")).alias("time")))
    pod = F.concat(F.col("service"), F.lit("-"), F.col("instance"))
    path = F.concat(F.lit("/var/log/containers/"), pod, F.lit("_monitoring_"), F.col("service"), F.lit("-"),
                    F.sha2(pod, 256), F.lit(".log"))
    return L.select("event_id", path.alias("file"), outer.alias("value"))


_DOCKER_SQL = with_views("logs") + """
SELECT event_id, t_us, CASE WHEN event_id % 43 = 0 THEN NULL ELSE level END AS level,
       CASE WHEN event_id % 43 = 0 THEN NULL ELSE msg END AS msg,
       CASE WHEN event_id % 43 = 0 OR event_id % 47 = 0 THEN NULL ELSE status END AS status,
       CASE WHEN event_id % 43 = 0 OR event_id % 47 = 0 THEN NULL ELSE round(latency_ms, 6) END AS latency_ms,
       CASE WHEN event_id % 43 = 0 THEN 'plain text ' || CAST(event_id AS VARCHAR) END AS raw, stream
FROM logs"""


@query("src_container_logs", _DOCKER_SQL)
def q_src_container_logs(spark, d):
    r = ps.src_container_logs(docker_lines(spark, d))
    return r.select("event_id", "t_us", "level", "msg", "status", R6("latency_ms").alias("latency_ms"), "raw",
                    "stream")


@query("log_flatten_dots", with_views("requests") + """
SELECT event_id, CASE WHEN event_id % 43 <> 0 AND k % 5 = 0 THEN 'http_route=' || route ELSE '' END AS extras
FROM requests""")
def q_log_flatten_dots(spark, d):
    r = ps.log_flatten_dots(ps.src_container_logs(docker_lines(spark, d)))
    return r.select("event_id", F.coalesce(label_text("extras"), F.lit("")).alias("extras"))


@query("log_k8s_enrich", with_views("logs") + """
SELECT event_id, service || '-' || instance AS pod_name, 'monitoring' AS namespace_name, service AS container_name,
       instance AS host, service AS app FROM logs""")
def q_log_k8s_enrich(spark, d):
    L = ps.src_container_logs(docker_lines(spark, d))
    lg = fx.logs(spark, d)
    pods = (lg.groupBy(F.concat("service", F.lit("-"), "instance").alias("pod_name"),
                       F.lit("monitoring").alias("namespace_name"))
            .agg(F.first("instance").alias("host"), F.first("service").alias("_app"))
            .withColumn("labels", F.create_map(F.lit("app"), F.col("_app"))).drop("_app"))
    e = ps.log_k8s_enrich(L, pods)
    return e.select("event_id", "kubernetes.pod_name", "kubernetes.namespace_name", "kubernetes.container_name",
                    "kubernetes.host", F.element_at("kubernetes.labels", F.lit("app")).alias("app"))


def cri_lines(spark, d):
    L = _logs_k(spark, d)
    inner = _inner_json(L)
    t = ps.us_to_rfc3339(F.col("t_us"))
    pod = F.concat(F.col("service"), F.lit("-"), F.col("instance"))
    path = F.concat(F.lit("/var/log/containers/"), pod, F.lit("_monitoring_"), F.col("service"), F.lit("-"),
                    F.sha2(pod, 256), F.lit(".log"))
    split = F.col("event_id") % 37 == 0
    pieces = F.when(split, F.array(
        F.struct(F.lit(0).alias("i"), F.lit("P").alias("tag"), F.substring(inner, 1, 20).alias("txt")),
        F.struct(F.lit(1).alias("i"), F.lit("F").alias("tag"), F.expr("substring(_inner, 21)").alias("txt")))
    ).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit("F").alias("tag"), inner.alias("txt"))))
    x = L.withColumn("_inner", inner).select("event_id", path.alias("file"), t.alias("_t"), "stream",
                                             F.explode(pieces).alias("_p"))
    return x.select("file", (F.col("event_id") * 2 + F.col("_p.i")).alias("line_no"),
                    F.concat_ws(" ", "_t", "stream", "_p.tag", "_p.txt").alias("value"))


@query("src_cri_logs", with_views("logs") + """
SELECT t_us, level, msg, CASE WHEN event_id % 47 <> 0 THEN status END AS status, service FROM logs""")
def q_src_cri_logs(spark, d):
    r = ps.src_cri_logs(cri_lines(spark, d), lines=500)
    return r.select("t_us", "level", "msg", "status", "service")


@query("log_daily_partition", with_views("logs") + """
SELECT 'logs-' || strftime(make_timestamp(t_us), '%Y.%m.%d') AS index, strftime(make_timestamp(t_us), '%Y-%m-%d') AS day,
       count(*) AS n FROM logs GROUP BY ALL""")
def q_log_daily_partition(spark, d):
    return sk.log_daily_partition(fx.logs(spark, d)).groupBy("index", "day").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ sinks and retention

@query("sink_samples", with_views("samples") + """
SELECT strftime(make_timestamp(t_us), '%Y-%m-%d') AS day, metric, series, t_us, round(value, 6) AS value FROM samples""")
def q_sink_samples(spark, d):
    path = _scratch(spark, "samples")
    sk.sink_samples(fx.samples(spark, d), path)
    back = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    return back.select("day", "metric", "series", "t_us", R6("value").alias("value"))


@query("retention", with_views("samples") + f"""
SELECT series, t_us, round(value, 6) AS value FROM (SELECT series, t_us - event_id % 3 * 86400000000 AS t_us, value FROM samples)
WHERE t_us >= {END - 90_000_000_000}""")
def q_retention(spark, d):
    """Samples of three days, written by day and metric; expired days are not read."""
    path = _scratch(spark, "samples-days")
    s = fx.samples(spark, d)
    sk.sink_samples(s.withColumn("t_us", F.col("t_us") - F.col("event_id") % 3 * 86_400_000_000), path)
    back = spark.read.option("basePath", path).parquet(path).withColumn("day", F.col("day").cast("string"))
    r = sk.retention(back, "25h", END)
    return r.select("series", "t_us", R6("value").alias("value"))


@query("tiered_read", with_views("samples") + """
SELECT series, t_us, round(value, 6) AS value FROM samples""")
def q_tiered_read(spark, d):
    s = fx.samples(spark, d).select("series", "t_us", "value", "event_id")
    hot = s.filter(F.col("t_us") >= END - 20 * 60_000_000)
    cold = s  # the long-term copy holds everything, including the hot range
    return sk.tiered_read(hot, cold).select("series", "t_us", R6("value").alias("value"))
