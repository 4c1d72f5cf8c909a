"""Registered queries: channel screen, volume filter, display units, pipeline rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.urls import channels_screen
from vigil.operators import alerts as al
from vigil.operators import histogram as hist
from vigil.operators import series as sr
from vigil.operators.scans import keyed_running_sum
from vigil.plans.fixture_sql import with_views
from vigil.plans.q_alerts import TTL5, _dedupe_sql, _rec
from vigil.plans.q_series import _GRID, _LOOKUP, END, R6, T0, _rate_sql
from vigil.plans.registry import query
from vigil.sources import fixtures as fx


# What each extra channel URL of the fixture must give (hand-made; the page URLs are checked by the SQL).
_EXTRA_REASONS = ["url host is restricted", "url host is restricted", "url host is restricted", "url user info is not allowed",
                  "url scheme must be http or https", *["url host is restricted"] * 6, None, None, None, "invalid url", None]


@query("channels_screen", """
WITH p AS (SELECT page_id AS id, trim(url) AS u,
             lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
             regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS auth FROM pages),
h AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(auth, '^.*@', ''), ':[0-9]*$', '')), '\\.$', '')
               AS host FROM p),
o AS (SELECT *, regexp_full_match(host, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') AS v4,
             TRY_CAST(split_part(host, '.', 1) AS INTEGER) AS o1, TRY_CAST(split_part(host, '.', 2) AS INTEGER) AS o2
      FROM h)
SELECT id, CASE WHEN strlen(u) = 0 OR strlen(u) > 512 THEN 'url must be 1-512 characters'
                WHEN scheme NOT IN ('http', 'https') THEN 'url scheme must be http or https'
                WHEN host = '' THEN 'url host is required'
                WHEN contains(auth, '@') THEN 'url user info is not allowed'
                WHEN host = 'localhost' OR ends_with(host, '.localhost') OR host = '0'
                     OR (v4 AND (o1 IN (127, 10) OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168)
                                 OR (o1 = 169 AND o2 = 254) OR o1 BETWEEN 224 AND 239 OR host = '0.0.0.0'))
                     THEN 'url host is restricted' END AS reason
FROM o UNION ALL SELECT * FROM (VALUES """ + ", ".join(
    f"({-(i + 1)}, {'NULL' if r is None else repr(r)})" for i, r in enumerate(_EXTRA_REASONS)) + ")")
def q_channels_screen(spark, d):
    return channels_screen(fx.channels(spark, d)).select("id", "reason")


_MOUNTS = ["/", "/boot", "/data", "/proc", "/sys/fs/cgroup", "/run", "/var/lib/docker"]
_TYPES = sr.PSEUDO_FS + ["ext4", "XFS", "TMPFS"]


def partitions(spark, d):
    b = fx.events_base(spark, d)
    m = F.element_at(F.array(*[F.lit(x) for x in _MOUNTS]), (F.col("k") % len(_MOUNTS) + 1).cast("int"))
    t = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("k") % len(_TYPES) + 1).cast("int"))
    return b.select("event_id", m.alias("mountpoint"), t.alias("fstype"))


def _sql_list(xs):
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


@query("volume_filter", with_views("base") + f""",
p AS (SELECT event_id, ({_sql_list(_MOUNTS)})[k % {len(_MOUNTS)} + 1] AS mountpoint,
             ({_sql_list(_TYPES)})[k % {len(_TYPES)} + 1] AS fstype FROM base)
SELECT mountpoint, fstype, count(*) AS n FROM p
WHERE mountpoint = '/' OR lower(coalesce(fstype, '')) NOT IN ({', '.join("'" + x + "'" for x in sr.PSEUDO_FS)})
GROUP BY ALL""")
def q_volume_filter(spark, d):
    v = sr.volume_filter(partitions(spark, d))
    return v.groupBy("mountpoint", "fstype").agg(F.count(F.lit(1)).alias("n"))


_UNITS_SQL = f""", {_GRID}, sel AS (SELECT * FROM samples WHERE metric = 'cpu_usage_percent'),
lk AS ({_LOOKUP.format(src='sel')}),
cpu AS (SELECT series, arg_max(value, eval_us) AS v FROM lk GROUP BY series),
net0 AS (SELECT * FROM samples WHERE metric = 'network_recv_bytes_total'), {_rate_sql('net0').strip()},
net AS (SELECT series, arg_max(value, eval_us) AS v FROM rated GROUP BY series)
SELECT series, 'percent' AS unit, printf('%.1f%%', round(v, 1)) AS text FROM cpu
UNION ALL SELECT series, 'bytes_per_s', CASE WHEN v >= 1048576 THEN printf('%.2f MB/s', v / 1048576)
    WHEN v >= 1024 THEN printf('%.1f KB/s', v / 1024) ELSE printf('%.0f B/s', v) END FROM net
UNION ALL SELECT series, 'uptime', CASE WHEN v * 4000 >= 86400
    THEN printf('%dd %dh', CAST(floor(v * 4000 / 86400) AS BIGINT), CAST(floor(v * 4000 % 86400 / 3600) AS BIGINT))
    ELSE printf('%dh', CAST(floor(v * 4000 / 3600) AS BIGINT)) END FROM cpu
UNION ALL SELECT series, 'number', CASE WHEN round(v, 1) = floor(round(v, 1)) THEN CAST(CAST(round(v, 1) AS BIGINT) AS VARCHAR)
    ELSE printf('%.1f', round(v, 1)) END FROM cpu"""


@query("display_units", with_views("samples") + _UNITS_SQL)
def q_display_units(spark, d):
    """Host detail texts for the latest cpu, network rate and an uptime derived from it."""
    s = fx.samples(spark, d)
    cpu = sr.latest_point(sr.range_vector_grid(sr.select_series(s, "cpu_usage_percent"), T0, END, "1m"))
    net = sr.latest_point(sr.rate(sr.select_series(s, "network_recv_bytes_total"), T0, END, "1m"))
    a = sr.display_units(cpu, "percent").select("series", F.lit("percent").alias("unit"), "text")
    b = sr.display_units(net, "bytes_per_s").select("series", F.lit("bytes_per_s").alias("unit"), "text")
    c = sr.display_units(cpu.withColumn("value", F.col("value") * 4000), "uptime").select(
        "series", F.lit("uptime").alias("unit"), "text")
    n = sr.display_units(cpu, "number").select("series", F.lit("number").alias("unit"), "text")
    return a.unionByName(b).unionByName(c).unionByName(n)


def pipeline_counter_samples(spark, d):
    """``alert_events_total{status,result}`` counters of the event consumer (one sample per event)."""
    e = al.alert_dedupe_ttl(fx.alerts(spark, d), "5m")
    e = e.withColumn("result", F.when(F.col("accepted"), "stored").otherwise("deduped")) \
         .withColumn("_one", F.lit(1).cast("bigint")).withColumn("t_us", F.col("received_us"))
    run = keyed_running_sum(e, ["status", "result"], "t_us", "event_id", "_one", "_n")
    lab = F.create_map(F.lit("job"), F.lit("alert"), F.lit("result"), F.col("result"), F.lit("status"), F.col("status"))
    from vigil.functions.labels import series_key
    return run.select(F.lit("alert_events_total").alias("metric"), lab.alias("labels"),
                      F.lit("event-consumer").alias("instance"), "t_us", F.col("_n").cast("double").alias("value"),
                      "event_id").withColumn("series", series_key("metric", "labels"))


@query("pipeline_rates", _rec(with_views("alerts")) + _dedupe_sql(TTL5) + f", {_GRID}," + """
cnt AS (SELECT 'alert_events_total' AS metric, 'event-consumer' AS instance,
               'job=alert,result=' || CASE WHEN accepted THEN 'stored' ELSE 'deduped' END || ',status=' || status AS labels,
               received_us AS t_us, event_id,
               CAST(count(*) OVER (PARTITION BY status, accepted ORDER BY received_us, event_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value FROM ded),
cs AS (SELECT *, metric || '{' || labels || '}' AS series FROM cnt),""" + _rate_sql("cs")[1:] + """
SELECT regexp_extract(labels, 'result=([^,]*)', 1) AS result, eval_us, round(sum(value), 6) AS value
FROM rated GROUP BY ALL""")
def q_pipeline_rates(spark, d):
    r = hist.pipeline_rates(pipeline_counter_samples(spark, d), "alert_events_total", ["result"], T0, END, "1m")
    return r.select("result", "eval_us", R6("value").alias("value"))


@query("pipeline_status_rates", _rec(with_views("alerts")) + _dedupe_sql(TTL5) + f", {_GRID}," + """
cnt AS (SELECT 'alert_events_total' AS metric, 'event-consumer' AS instance,
               'job=alert,result=' || CASE WHEN accepted THEN 'stored' ELSE 'deduped' END || ',status=' || status AS labels,
               received_us AS t_us, event_id,
               CAST(count(*) OVER (PARTITION BY status, accepted ORDER BY received_us, event_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value FROM ded),
cs AS (SELECT *, metric || '{' || labels || '}' AS series FROM cnt),""" + _rate_sql("cs")[1:] + """
SELECT regexp_extract(labels, 'status=([^,]*)', 1) AS status, regexp_extract(labels, 'result=([^,]*)', 1) AS result, eval_us, round(sum(value), 6) AS value
FROM rated GROUP BY ALL""")
def q_pipeline_status_rates(spark, d):
    r = hist.pipeline_rates(pipeline_counter_samples(spark, d), "alert_events_total", ["status", "result"], T0, END, "1m")
    return r.select("status", "result", "eval_us", R6("value").alias("value"))
