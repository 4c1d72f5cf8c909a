"""Registered queries: selection, lookups and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import histogram as hist
from vigil.operators import series as sr
from vigil.plans.fixture_sql import with_views
from vigil.plans.registry import query
from vigil.sources import fixtures as fx

T0 = fx.T0_US
END = fx.EVAL_END_US
LB = 300_000_000
STEP = 60_000_000
R6 = lambda c: F.round(F.col(c), 6)

_GRID = f"ticks AS (SELECT unnest(range({T0}, {END} + 1, {STEP})) AS eval_us)"
# DuckDB: newest sample per (series, tick) within the lookback, by range join (independent of the explode plan).
_LOOKUP = f"""
SELECT s.series, t.eval_us, arg_max(s.value, (s.t_us, s.event_id)) AS value, max(s.t_us) AS sample_us,
       any_value(s.instance) AS instance, any_value(s.metric) AS metric, any_value(s.labels) AS labels
FROM ticks t JOIN {{src}} s ON s.t_us BETWEEN t.eval_us - {LB} AND t.eval_us
GROUP BY s.series, t.eval_us"""


@query("select_series", with_views("samples") + """
SELECT series, t_us, round(value, 6) AS value FROM samples
WHERE metric = 'disk_usage_percent' AND regexp_full_match(regexp_extract(labels, 'mountpoint=([^,]*)', 1), '/d.*')
  AND instance <> 'host-3'""")
def q_select_series(spark, d):
    s = sr.select_series(fx.samples(spark, d), "disk_usage_percent",
                         [("mountpoint", "=~", "/d.*"), ("instance", "!=", "host-3")])
    return s.select("series", "t_us", R6("value").alias("value"))


@query("select_series_stored", with_views("samples") + """
SELECT series, t_us, round(value, 6) AS value FROM samples
WHERE metric = 'disk_usage_percent' AND regexp_full_match(regexp_extract(labels, 'mountpoint=([^,]*)', 1), '/d.*')
  AND instance <> 'host-3'""")
def q_select_series_stored(spark, d):
    """The same selection over samples stored by series id, appended in two parts."""
    from vigil.sources import series_store as st
    from vigil.streaming.jobs import scratch

    s, path = fx.samples(spark, d), scratch(spark, "series-store")
    for half in (0, 1):
        st.append_series_store(s.filter(F.pmod("event_id", F.lit(2)) == half), path, shards=8)
    found = st.select_stored(spark, path, "disk_usage_percent", [("mountpoint", "=~", "/d.*"), ("instance", "!=", "host-3")])
    return found.select("series", "t_us", R6("value").alias("value"))


@query("instant_vector", with_views("samples") + f"""
SELECT series, CAST({END} AS BIGINT) AS eval_us, round(arg_max(value, (t_us, event_id)), 6) AS value,
       max(t_us) AS sample_us
FROM samples WHERE t_us BETWEEN {END - LB} AND {END} GROUP BY series""")
def q_instant_vector(spark, d):
    v = sr.instant_vector(fx.samples(spark, d), END, "5m")
    return v.select("series", "eval_us", R6("value").alias("value"), "sample_us")


@query("range_vector_grid", with_views("samples") + f", {_GRID}, lk AS ({_LOOKUP.format(src='samples')})" + """
SELECT series, eval_us, round(value, 6) AS value, sample_us FROM lk""")
def q_range_vector_grid(spark, d):
    v = sr.range_vector_grid(fx.samples(spark, d), T0, END, "1m", "5m")
    return v.select("series", "eval_us", R6("value").alias("value"), "sample_us")


@query("latest_point", with_views("samples") + """
SELECT series, round(arg_max(value, (t_us, event_id)), 6) AS value, max(t_us) AS t_us
FROM samples WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY series""")
def q_latest_point(spark, d):
    s = fx.samples(spark, d)
    v = sr.latest_point(s.withColumn("eval_us", F.col("t_us")))
    return v.select("series", R6("value").alias("value"), F.col("eval_us").alias("t_us"))


@query("label_values", with_views("samples") + """
SELECT DISTINCT regexp_extract(labels, 'mountpoint=([^,]*)', 1) AS value FROM samples
WHERE metric = 'disk_usage_percent'""")
def q_label_values(spark, d):
    return sr.label_values(fx.samples(spark, d), "mountpoint", "disk_usage_percent")


@query("disk_by_mount", with_views("samples") + f", {_GRID}, sel AS (SELECT * FROM samples WHERE metric = "
       "'disk_usage_percent' AND instance = 'host-3' AND labels LIKE '%mountpoint=/data'), "
       f"lk AS ({_LOOKUP.format(src='sel')})" + """
SELECT instance, eval_us, round(value, 6) AS value FROM lk""")
def q_disk_by_mount(spark, d):
    s = sr.select_series(fx.samples(spark, d), "disk_usage_percent", [("instance", "=", "host-3")])
    g = sr.range_vector_grid(s, T0, END, "1m")
    return sr.disk_by_mount(g, "host-3", "/data").select("instance", "eval_us", R6("value").alias("value"))


@query("disk_max", with_views("samples") + f", {_GRID}, sel AS (SELECT * FROM samples WHERE metric = "
       f"'disk_usage_percent'), lk AS ({_LOOKUP.format(src='sel')})" + """
SELECT instance, eval_us, round(max(value), 6) AS value FROM lk GROUP BY instance, eval_us""")
def q_disk_max(spark, d):
    s = sr.select_series(fx.samples(spark, d), "disk_usage_percent")
    g = sr.disk_max(sr.range_vector_grid(s, T0, END, "1m"))
    return g.select("instance", "eval_us", R6("value").alias("value"))


# ------------------------------------------------------------------ rate family (DuckDB twin of §2.12)

def _rate_sql(src: str, kind: str = "rate", win: int = LB) -> str:
    """Per (series, tick) window stats by range join, then the extrapolation rule."""
    factor_rate = f" / {win / 1e6}" if kind == "rate" else ""
    resets = "resets" if kind != "delta" else "0"
    return f"""
lagged AS (SELECT *, lag(value) OVER w AS prev_value, lag(t_us) OVER w AS prev_t_us FROM {src}
           WINDOW w AS (PARTITION BY series ORDER BY t_us, event_id)),
st AS (SELECT s.series, any_value(s.instance) AS instance, any_value(s.labels) AS labels, t.eval_us,
              count(*) AS n, min(s.t_us) AS first_us, max(s.t_us) AS last_us,
              arg_min(s.value, (s.t_us, s.event_id)) AS first_v, arg_max(s.value, (s.t_us, s.event_id)) AS last_v,
              sum(CASE WHEN s.prev_value IS NOT NULL AND s.value < s.prev_value
                        AND s.prev_t_us >= t.eval_us - {win} THEN s.prev_value ELSE 0 END) AS resets
       FROM ticks t JOIN lagged s ON s.t_us BETWEEN t.eval_us - {win} AND t.eval_us
       GROUP BY s.series, t.eval_us),
ex AS (SELECT *, last_v - first_v + {resets} AS res,
              (first_us - (eval_us - {win})) / 1e6 AS ds0, (eval_us - last_us) / 1e6 AS de,
              (last_us - first_us) / 1e6 AS si, (last_us - first_us) / 1e6 / (n - 1) AS av
       FROM st WHERE n >= 2 AND last_us > first_us),
ex2 AS (SELECT *, CASE WHEN res > 0 AND first_v >= 0 AND si * (first_v / res) < ds0 THEN si * (first_v / res)
                       ELSE ds0 END AS ds FROM ex),
rated AS (SELECT series, instance, labels, eval_us,
                 res * ((si + CASE WHEN ds < av * 1.1 THEN ds ELSE av / 2 END
                            + CASE WHEN de < av * 1.1 THEN de ELSE av / 2 END) / si){factor_rate} AS value
          FROM ex2)"""


@query("rate", with_views("samples") + f", {_GRID}, sel AS (SELECT * FROM samples WHERE metric = "
       f"'network_recv_bytes_total'), {_rate_sql('sel')}" + """
SELECT series, eval_us, round(value, 6) AS value FROM rated""")
def q_rate(spark, d):
    s = sr.select_series(fx.samples(spark, d), "network_recv_bytes_total")
    return sr.rate(s, T0, END, "1m", "5m").select("series", "eval_us", R6("value").alias("value"))


@query("increase", with_views("samples") + f", {_GRID}, sel AS (SELECT * FROM samples WHERE metric = "
       f"'network_recv_bytes_total'), {_rate_sql('sel', 'increase')}" + """
SELECT series, eval_us, round(value, 6) AS value FROM rated""")
def q_increase(spark, d):
    s = sr.select_series(fx.samples(spark, d), "network_recv_bytes_total")
    return sr.increase(s, T0, END, "1m", "5m").select("series", "eval_us", R6("value").alias("value"))


@query("over_time", with_views("samples") + f", {_GRID}" + f"""
SELECT s.series, t.eval_us, round(avg(s.value), 6) AS avg_v, round(max(s.value), 6) AS max_v, round(min(s.value), 6) AS min_v,
       round(sum(s.value), 6) AS sum_v, CAST(count(*) AS DOUBLE) AS count_v
FROM ticks t JOIN samples s ON s.t_us BETWEEN t.eval_us - {LB} AND t.eval_us
WHERE s.metric = 'cpu_usage_percent' GROUP BY s.series, t.eval_us""")
def q_over_time(spark, d):
    s, out = sr.select_series(fx.samples(spark, d), "cpu_usage_percent"), None
    for fn in ("avg", "max", "min", "sum", "count"):
        v = sr.over_time(s, fn, T0, END, STEP, "5m").select("series", "eval_us", R6("value").alias(f"{fn}_v"))
        out = v if out is None else out.join(v, ["series", "eval_us"])
    return out


@query("counter_accumulate", with_views("raw_counters") + """,
l AS (SELECT *, lag(value) OVER (PARTITION BY instance, iface ORDER BY t_us, event_id) AS pv FROM raw_counters)
SELECT instance, iface, t_us, event_id, value,
       sum(CASE WHEN pv IS NULL OR value < pv THEN value ELSE value - pv END)
         OVER (PARTITION BY instance, iface ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS total,
       COALESCE(value < pv, false) AS was_reset
FROM l""")
def q_counter_accumulate(spark, d):
    return sr.counter_accumulate(fx.raw_counters(spark, d), ["instance", "iface"])


_NUMBER = "coalesce({0}(s.value) FILTER (WHERE NOT isnan(s.value)), 'NaN'::DOUBLE)"


@query("over_time_nan", with_views("samples") + f", {_GRID}" + f""",
n AS (SELECT * REPLACE (CASE WHEN event_id % 13 = 0 OR instance = 'host-3' AND t_us < {T0 + 1_200_000_000} THEN 'NaN'::DOUBLE ELSE value END AS value) FROM samples)
SELECT s.series, t.eval_us, round({_NUMBER.format('max')}, 6) AS max_v, round({_NUMBER.format('min')}, 6) AS min_v, round(avg(s.value), 6) AS avg_v,
       CAST(count(*) AS DOUBLE) AS count_v
FROM ticks t JOIN n s ON s.t_us BETWEEN t.eval_us - {LB} AND t.eval_us
WHERE s.metric = 'cpu_usage_percent' GROUP BY s.series, t.eval_us""")
def q_over_time_nan(spark, d):
    """Windows with some and with only NaN samples: extremes are those of the numbers."""
    s, out = sr.select_series(fx.samples(spark, d), "cpu_usage_percent"), None
    bad = (F.col("event_id") % 13 == 0) | ((F.col("instance") == "host-3") & (F.col("t_us") < T0 + 1_200_000_000))
    s = s.withColumn("value", F.when(bad, F.lit(float("nan"))).otherwise(F.col("value")))
    for fn in ("max", "min", "avg", "count"):
        v = sr.over_time(s, fn, T0, END, STEP, "5m").select("series", "eval_us", R6("value").alias(f"{fn}_v"))
        out = v if out is None else out.join(v, ["series", "eval_us"])
    return out


@query("disk_without_mount_nan", with_views("samples") + f", {_GRID}" + f""",
sel AS (SELECT * REPLACE (CASE WHEN contains(labels, 'mountpoint=/data') THEN 'NaN'::DOUBLE ELSE value END AS value) FROM samples
        WHERE metric = 'disk_usage_percent' AND instance = 'host-7'), lk AS ({_LOOKUP.format(src='sel')})
SELECT series0 AS series, eval_us, round(coalesce(max(value) FILTER (WHERE NOT isnan(value)), 'NaN'::DOUBLE), 6) AS value
FROM (SELECT 'disk_usage_percent{{instance=' || instance || '}}' AS series0, * FROM lk) GROUP BY series0, eval_us""")
def q_disk_without_mount_nan(spark, d):
    """One mount reports NaN: the host's disk use is that of the others."""
    s = fx.samples(spark, d)
    bad = (F.col("metric") == "disk_usage_percent") & (F.element_at("labels", F.lit("mountpoint")) == "/data")
    s = s.withColumn("value", F.when(bad, F.lit(float("nan"))).otherwise(F.col("value")))
    v = sr.metric_catalogue(s, "disk_usage", T0, END, "1m", instance="host-7")
    return v.select("series", "eval_us", R6("value").alias("value"))


# Every 13th sample is not a number where a query is about NaN.
_NAN_SQL = "SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value) FROM samples"


def _nan(S):
    return S.withColumn("value", F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value")))


@query("agg_by", with_views("samples") + f", {_GRID}, sel AS ({_NAN_SQL} WHERE metric = "
       f"'disk_usage_percent'), lk AS ({_LOOKUP.format(src='sel')})" + """
SELECT instance, eval_us, round(sum(value), 6) AS sum_v, round(avg(value), 6) AS avg_v,
       round(coalesce(max(value) FILTER (WHERE NOT isnan(value)), 'NaN'::DOUBLE), 6) AS max_v,
       round(coalesce(min(value) FILTER (WHERE NOT isnan(value)), 'NaN'::DOUBLE), 6) AS min_v, CAST(count(*) AS DOUBLE) AS count_v
FROM lk GROUP BY instance, eval_us""")
def q_agg_by(spark, d):
    g = sr.range_vector_grid(sr.select_series(_nan(fx.samples(spark, d)), "disk_usage_percent"), T0, END, "1m")
    out = None
    for fn in ("sum", "avg", "max", "min", "count"):
        a = sr.agg_by(g, fn, ["instance"]).select("instance", "eval_us", R6("value").alias(f"{fn}_v"))
        out = a if out is None else out.join(a, ["instance", "eval_us"])
    return out


@query("agg_all", with_views("samples") + f", {_GRID}, sel AS (SELECT * FROM samples WHERE metric = 'up'), "
       f"lk AS ({_LOOKUP.format(src='sel')})" + """
SELECT eval_us, round(sum(value), 6) AS value, CAST(count(*) AS DOUBLE) AS n FROM lk GROUP BY eval_us""")
def q_agg_all(spark, d):
    g = sr.range_vector_grid(sr.select_series(fx.samples(spark, d), "up"), T0, END, "1m")
    n = sr.agg_all(g, "count").withColumnRenamed("value", "n")
    return sr.agg_all(g, "sum").join(n, "eval_us").select("eval_us", R6("value").alias("value"), "n")


@query("compare_filter", with_views("samples") + f", {_GRID}, sel AS ({_NAN_SQL} WHERE metric = "
       f"'cpu_usage_percent'), lk AS ({_LOOKUP.format(src='sel')})" + """
SELECT series, eval_us, round(value, 6) AS value FROM lk WHERE value > 80 AND NOT isnan(value)""")
def q_compare_filter(spark, d):
    g = sr.range_vector_grid(sr.select_series(_nan(fx.samples(spark, d)), "cpu_usage_percent"), T0, END, "1m")
    return sr.compare_filter(g, ">", 80).select("series", "eval_us", R6("value").alias("value"))


@query("scalar_arith", with_views("samples") + f", {_GRID}, sel AS (SELECT * FROM samples WHERE metric = 'up'), "
       f"lk AS ({_LOOKUP.format(src='sel')})" + """
SELECT eval_us, round(100 - avg(value) * 100, 6) AS value FROM lk GROUP BY eval_us""")
def q_scalar_arith(spark, d):
    g = sr.range_vector_grid(sr.select_series(fx.samples(spark, d), "up"), T0, END, "1m")
    a = sr.scalar_arith(sr.agg_all(g, "avg"), "100 - value * 100")
    return a.select("eval_us", R6("value").alias("value"))


@query("vector_div", with_views("samples") + f", {_GRID}, "
       f"c AS ({_NAN_SQL} WHERE metric = 'cpu_usage_percent'), "
       f"m AS ({_NAN_SQL} WHERE metric = 'memory_usage_percent'), "
       f"lc AS ({_LOOKUP.format(src='c')}), lm AS ({_LOOKUP.format(src='m')})" + """
SELECT lc.instance, lc.eval_us,
       round(CASE WHEN isnan(lc.value) OR isnan(lm.value) THEN 'NaN'::DOUBLE WHEN lm.value <> 0 THEN lc.value / lm.value WHEN lc.value > 0 THEN 'Infinity'::DOUBLE
                  WHEN lc.value < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END, 6) AS value
FROM lc JOIN lm ON lc.instance = lm.instance AND lc.eval_us = lm.eval_us""")
def q_vector_div(spark, d):
    s = _nan(fx.samples(spark, d))
    c = sr.range_vector_grid(sr.select_series(s, "cpu_usage_percent"), T0, END, "1m")
    m = sr.range_vector_grid(sr.select_series(s, "memory_usage_percent"), T0, END, "1m")
    return sr.vector_div(c, m, ["instance"]).select("instance", "eval_us", R6("value").alias("value"))


@query("and_on", with_views("samples") + f", {_GRID}, "
       f"c AS (SELECT * FROM samples WHERE metric = 'cpu_usage_percent'), "
       f"m AS (SELECT * FROM samples WHERE metric = 'memory_usage_percent'), "
       f"lc AS ({_LOOKUP.format(src='c')}), lm AS ({_LOOKUP.format(src='m')})" + """
SELECT instance, eval_us, round(value, 6) AS value FROM lc
WHERE EXISTS (SELECT 1 FROM lm WHERE lm.instance = lc.instance AND lm.eval_us = lc.eval_us AND lm.value > 50)""")
def q_and_on(spark, d):
    s = fx.samples(spark, d)
    c = sr.range_vector_grid(sr.select_series(s, "cpu_usage_percent"), T0, END, "1m")
    m = sr.compare_filter(sr.range_vector_grid(sr.select_series(s, "memory_usage_percent"), T0, END, "1m"), ">", 50)
    return sr.and_on(c, m, ["instance"]).select("instance", "eval_us", R6("value").alias("value"))


@query("set_ops", with_views("samples") + f", {_GRID}, "
       f"c AS (SELECT * FROM samples WHERE metric = 'cpu_usage_percent'), "
       f"m AS (SELECT * FROM samples WHERE metric = 'memory_usage_percent'), "
       f"lc AS ({_LOOKUP.format(src='c')}), lm AS ({_LOOKUP.format(src='m')}), "
       "hc AS (SELECT * FROM lc WHERE value > 70), hm AS (SELECT * FROM lm WHERE value > 70)" + """
SELECT 'unless' AS op, instance, eval_us, round(value, 6) AS value FROM hc
WHERE NOT EXISTS (SELECT 1 FROM hm WHERE hm.instance = hc.instance AND hm.eval_us = hc.eval_us)
UNION ALL
SELECT 'or', instance, eval_us, round(value, 6) FROM hc
UNION ALL
SELECT 'or', instance, eval_us, round(value, 6) FROM hm
WHERE NOT EXISTS (SELECT 1 FROM hc WHERE hm.instance = hc.instance AND hm.eval_us = hc.eval_us)""")
def q_set_ops(spark, d):
    s = fx.samples(spark, d)
    c = sr.compare_filter(sr.range_vector_grid(sr.select_series(s, "cpu_usage_percent"), T0, END, "1m"), ">", 70)
    m = sr.compare_filter(sr.range_vector_grid(sr.select_series(s, "memory_usage_percent"), T0, END, "1m"), ">", 70)
    u = sr.unless(c, m, ["instance"]).select(F.lit("unless").alias("op"), "instance", "eval_us", "value")
    o = sr.or_(c, m, ["instance"]).select(F.lit("or").alias("op"), "instance", "eval_us", "value")
    return u.unionByName(o).select("op", "instance", "eval_us", R6("value").alias("value"))


@query("topk", with_views("samples") + f", {_GRID}, sel AS ({_NAN_SQL} WHERE metric = "
       f"'cpu_usage_percent'), lk AS ({_LOOKUP.format(src='sel')})" + """
SELECT series, eval_us, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY eval_us ORDER BY isnan(value), value DESC, series) AS r FROM lk) WHERE r <= 3""")
def q_topk(spark, d):
    g = sr.range_vector_grid(sr.select_series(_nan(fx.samples(spark, d)), "cpu_usage_percent"), T0, END, "1m")
    return sr.topk(g, 3).select("series", "eval_us", R6("value").alias("value"))


# Metrics of the catalogue that the fixture lacks are derived from the ones it has: name -> (source, factor).
DERIVED = {"memory_total_bytes": ("memory_usage_percent", 1000.0), "memory_available_bytes": ("memory_usage_percent", 10.0),
           "load1": ("cpu_usage_percent", 0.5), "load5": ("cpu_usage_percent", 0.25), "load15": ("cpu_usage_percent", 0.125),
           "process_count": ("cpu_usage_percent", 2.0), "uptime_seconds": ("cpu_usage_percent", 4000.0),
           "network_sent_bytes_total": ("network_recv_bytes_total", 1.0)}
_WIDE_SQL = "wide AS (SELECT * FROM samples" + "".join(
    f" UNION ALL SELECT * REPLACE ('{m}' AS metric, '{m}{{' || labels || '}}' AS series, value * {f} AS value) FROM samples WHERE metric = '{src}'"
    for m, (src, f) in DERIVED.items()) + """
 UNION ALL SELECT * REPLACE ('ALERTS' AS metric, 'ALERTS{alertstate=' || CASE WHEN event_id % 2 = 0 THEN 'firing' ELSE 'pending' END || ',' || labels || '}' AS series)
   FROM samples WHERE metric = 'up')"""


def wide_samples(spark, d):
    """The fixture's samples and the derived metrics, so that the whole catalogue has rows."""
    from vigil.functions.labels import series_key

    s = out = fx.samples(spark, d)
    for m, (src, f) in DERIVED.items():
        t = s.filter(F.col("metric") == src).withColumn("metric", F.lit(m)).withColumn("value", F.col("value") * f)
        out = out.unionByName(t.withColumn("series", series_key("metric", "labels")))
    state = F.create_map(F.lit("alertstate"), F.when(F.col("event_id") % 2 == 0, "firing").otherwise("pending"))
    a = s.filter("metric = 'up'").withColumn("metric", F.lit("ALERTS")).withColumn("labels", F.map_concat("labels", state))
    return out.unionByName(a.withColumn("series", series_key("metric", "labels")))


def _catalogue_sql() -> str:
    """One row set per name: plain names by lookup, disk by maximum, rates by the rate rule."""
    gauges = {n: m for n, (m, kind) in sr.CATALOGUE.items() if kind == "gauge"}
    named = ", ".join(f"('{n}', '{m}')" for n, m in gauges.items())
    rates = ", ".join(f"('{n}', '{m}')" for n, (m, kind) in sr.CATALOGUE.items() if kind == "rate")
    return with_views("samples") + f", {_GRID}, {_WIDE_SQL}, lk AS ({_LOOKUP.format(src='wide')}), g(name, metric) AS (VALUES {named}), " \
        f"rt(name, metric) AS (VALUES {rates}), sel AS (SELECT * FROM wide WHERE metric IN (SELECT metric FROM rt) AND instance = 'host-7'), " \
        + _rate_sql("sel").strip() + """
SELECT name, series, eval_us, round(value, 6) AS value FROM lk JOIN g USING (metric) WHERE instance = 'host-7'
UNION ALL SELECT 'disk_usage', 'disk_usage_percent{instance=' || instance || '}', eval_us, round(max(value), 6) FROM lk
  WHERE metric = 'disk_usage_percent' AND instance = 'host-7' GROUP BY instance, eval_us
UNION ALL SELECT name, series, eval_us, round(value, 6) FROM rated JOIN rt ON starts_with(rated.series, rt.metric || '{')
UNION ALL SELECT 'host_list', series, eval_us, round(value, 6) FROM lk WHERE metric = 'up' AND contains(labels, 'job=probe')
UNION ALL SELECT 'active_alerts', series, eval_us, round(value, 6) FROM lk WHERE metric = 'ALERTS' AND contains(series, 'alertstate=firing')"""


@query("metric_catalogue", _catalogue_sql())
def q_metric_catalogue(spark, d):
    s, out = wide_samples(spark, d), None
    for name in sr.CATALOGUE:
        v = sr.metric_catalogue(s, name, T0, END, "1m", instance="host-7" if name in sr.NEEDS_INSTANCE else None)
        v = v.select(F.lit(name).alias("name"), "series", "eval_us", R6("value").alias("value"))
        out = v if out is None else out.unionByName(v)
    return out


_HMR_START = END - 3_600_000_000


@query("host_metric_ranges", with_views("samples")
       + f", ticks AS (SELECT unnest(range({_HMR_START}, {END} + 1, {STEP})) AS eval_us), "
       f"{_WIDE_SQL}, host AS (SELECT * FROM wide WHERE instance = 'host-7'), "
       "c AS (SELECT * FROM host WHERE metric = 'cpu_usage_percent'), "
       "m AS (SELECT * FROM host WHERE metric = 'memory_usage_percent'), "
       "dk AS (SELECT * FROM host WHERE metric = 'disk_usage_percent'), "
       "n AS (SELECT * FROM host WHERE metric IN ('network_recv_bytes_total', 'network_sent_bytes_total')), "
       "o AS (SELECT * FROM host WHERE metric IN ('load1', 'process_count', 'uptime_seconds')), "
       f"lc AS ({_LOOKUP.format(src='c')}), lm AS ({_LOOKUP.format(src='m')}), ld AS ({_LOOKUP.format(src='dk')}), "
       f"lo AS ({_LOOKUP.format(src='o')}), "
       + _rate_sql("n") + """
SELECT 'cpu' AS name, series, eval_us, round(value, 6) AS value FROM lc
UNION ALL SELECT 'memory', series, eval_us, round(value, 6) FROM lm
UNION ALL SELECT 'disk', 'disk_usage_percent{instance=' || instance || '}', eval_us, round(max(value), 6)
          FROM ld GROUP BY instance, eval_us
UNION ALL SELECT CASE metric WHEN 'uptime_seconds' THEN 'uptime' ELSE metric END, series, eval_us, round(value, 6) FROM lo
UNION ALL SELECT CASE WHEN starts_with(series, 'network_recv') THEN 'network_recv' ELSE 'network_sent' END, series, eval_us, round(value, 6)
          FROM rated""")
def q_host_metric_ranges(spark, d):
    v = sr.host_metric_ranges(wide_samples(spark, d), "host-7", "1h", now_us=END)
    return v.select("name", "series", "eval_us", R6("value").alias("value"))
