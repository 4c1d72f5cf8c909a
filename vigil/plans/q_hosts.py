"""Registered queries: histograms (§2.3) and hosts (§2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import histogram as hist
from vigil.operators import hosts as ho
from vigil.plans.fixture_sql import with_views
from vigil.plans.q_series import _GRID, _LOOKUP, END, LB, STEP, T0, R6, _rate_sql
from vigil.plans.registry import query
from vigil.sources import fixtures as fx

# ------------------------------------------------------------------ histograms


@query("histogram_observe", with_views("requests") + """,
b AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 'Infinity'::DOUBLE]) AS le)
SELECT r.instance, b.le, CAST(sum(CASE WHEN r.latency_s <= b.le THEN 1 ELSE 0 END) AS BIGINT) AS bucket_count,
       round(any_value(t.s), 6) AS sum, any_value(t.n) AS count
FROM requests r, b, (SELECT instance, sum(latency_s) AS s, count(*) AS n FROM requests GROUP BY instance) t
WHERE t.instance = r.instance
GROUP BY r.instance, b.le""")
def q_histogram_observe(spark, d):
    h = hist.histogram_observe(fx.requests(spark, d), "latency_s", ["instance"])
    return h.select("instance", "le", "bucket_count", R6("sum").alias("sum"), "count")


def _quantile_sql(phi: float, thr: str = "") -> str:
    return f""", bsel AS (SELECT *, metric || '{{' || labels || '}}' AS series FROM http_buckets),
{_rate_sql('bsel')},
bk AS (SELECT instance, eval_us, CAST(regexp_extract(labels, 'le=([^,]*)', 1) AS DOUBLE) AS le, sum(value) AS c
       FROM rated GROUP BY ALL),
m AS (SELECT *, max(c) OVER (PARTITION BY instance, eval_us ORDER BY le ROWS UNBOUNDED PRECEDING) AS cm,
             row_number() OVER (PARTITION BY instance, eval_us ORDER BY le) - 1 AS i,
             count(*) OVER (PARTITION BY instance, eval_us) AS n,
             max(c) OVER (PARTITION BY instance, eval_us) AS tot FROM bk),
m2 AS (SELECT *, lag(le) OVER w AS ple, lag(cm) OVER w AS pcm FROM m
       WINDOW w AS (PARTITION BY instance, eval_us ORDER BY le)),
pick AS (SELECT instance, eval_us,
                coalesce(min(i) FILTER (WHERE i < n - 1 AND cm >= {phi} * tot), max(n) - 1) AS b FROM m2 GROUP BY ALL),
q AS (SELECT m2.instance, m2.eval_us,
             CASE WHEN m2.tot = 0 THEN 'NaN'::DOUBLE
                  WHEN pick.b = m2.n - 1 THEN m2.ple
                  WHEN pick.b = 0 AND m2.le <= 0 THEN m2.le
                  ELSE coalesce(m2.ple, 0) + (m2.le - coalesce(m2.ple, 0))
                       * (({phi} * m2.tot - coalesce(m2.pcm, 0)) / (m2.cm - coalesce(m2.pcm, 0))) END AS value
      FROM m2 JOIN pick ON m2.instance = pick.instance AND m2.eval_us = pick.eval_us AND m2.i = pick.b)
SELECT instance, eval_us, round(value, 6) AS value FROM q {thr}"""


@query("histogram_quantile", with_views("http_buckets") + f", {_GRID}" + _quantile_sql(0.95))
def q_histogram_quantile(spark, d):
    s = fx.http_bucket_samples(spark, d)
    q = hist.p95_latency(s, T0, END, "1m", 0.95, threshold=None)
    return q.select("instance", "eval_us", R6("value").alias("value"))


@query("p95_latency", with_views("http_buckets") + f", {_GRID}" + _quantile_sql(0.95, "WHERE value > 1"))
def q_p95_latency(spark, d):
    s = fx.http_bucket_samples(spark, d)
    return hist.p95_latency(s, T0, END, "1m").select("instance", "eval_us", R6("value").alias("value"))


def _http_rate_sql() -> str:
    return (with_views("http_counter") + f", {_GRID}, hsel AS (SELECT *, metric || '{{' || labels || '}}' AS series "
            "FROM http_counter), " + _rate_sql("hsel"))


@query("error_ratio", _http_rate_sql() + """,
r2 AS (SELECT *, regexp_extract(labels, 'status=([^,]*)', 1) AS status FROM rated),
e AS (SELECT instance, eval_us, sum(value) AS v FROM r2 WHERE regexp_full_match(status, '5..') GROUP BY ALL),
t AS (SELECT instance, eval_us, sum(value) AS v FROM r2 GROUP BY ALL)
SELECT e.instance, e.eval_us,
       round(CASE WHEN t.v <> 0 THEN e.v / t.v WHEN e.v > 0 THEN 'Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END, 6) AS value
FROM e JOIN t ON e.instance = t.instance AND e.eval_us = t.eval_us
WHERE (CASE WHEN t.v <> 0 THEN e.v / t.v WHEN e.v > 0 THEN 'Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END) > 0.05
  AND t.v > 0""")
def q_error_ratio(spark, d):
    s = fx.http_counter_samples(spark, d)
    return hist.error_ratio(s, T0, END, "1m").select("instance", "eval_us", R6("value").alias("value"))


@query("request_rate_by_route", _http_rate_sql() + """,
r2 AS (SELECT *, regexp_extract(labels, 'path=([^,]*)', 1) AS path, regexp_extract(labels, 'status=([^,]*)', 1) AS status
       FROM rated)
SELECT 'route' AS view, eval_us, path || ' ' || status AS key, round(sum(value), 6) AS value FROM r2 GROUP BY ALL
UNION ALL
SELECT 'instance', eval_us, instance, round(sum(value), 6) FROM r2 GROUP BY ALL""")
def q_request_rate_by_route(spark, d):
    s = fx.http_counter_samples(spark, d)
    r = hist.request_rate_by_route(s, T0, END, "1m")
    return r.select("view", "eval_us", "key", R6("value").alias("value"))


# ------------------------------------------------------------------ hosts

def _snapshot_sql(lb: int = LB, *extra: str) -> str:
    return with_views("samples", *extra) + _snapshot_ctes(lb)


def _snapshot_ctes(lb: int = LB) -> str:
    return f""",
w AS (SELECT * FROM samples WHERE t_us BETWEEN {END - lb} AND {END}
        AND (metric IN ('cpu_usage_percent', 'memory_usage_percent') OR (metric = 'up' AND labels LIKE '%job=probe%'))),
u AS (SELECT instance, arg_max(value, (t_us, event_id)) AS v, max(t_us) AS t FROM w WHERE metric = 'up' GROUP BY ALL),
c AS (SELECT instance, arg_max(value, (t_us, event_id)) AS v, max(t_us) AS t FROM w
      WHERE metric = 'cpu_usage_percent' GROUP BY ALL),
m AS (SELECT instance, arg_max(value, (t_us, event_id)) AS v, max(t_us) AS t FROM w
      WHERE metric = 'memory_usage_percent' GROUP BY ALL),
inst AS (SELECT instance FROM u UNION SELECT instance FROM c UNION SELECT instance FROM m),
hosts AS (
SELECT i.instance, coalesce(c.v, 0.0) AS cpu, coalesce(m.v, 0.0) AS memory,
       CASE WHEN u.v IS NULL THEN 'unknown' WHEN u.v >= 1 THEN 'up' ELSE 'down' END AS status,
       greatest(u.t, c.t, m.t) - greatest(u.t, c.t, m.t) % 1000000 AS last_scrape_us
FROM inst i LEFT JOIN u ON u.instance = i.instance LEFT JOIN c ON c.instance = i.instance
     LEFT JOIN m ON m.instance = i.instance)"""


def _snap(spark, d, lb="5m"):
    return ho.host_snapshot(fx.samples(spark, d), END, lb)


def _hcols():
    return ["instance", R6("cpu").alias("cpu"), R6("memory").alias("memory"), "status", "last_scrape_us"]

_HSQL = "SELECT instance, round(cpu, 6) AS cpu, round(memory, 6) AS memory, status, last_scrape_us FROM hosts"


@query("host_snapshot", _snapshot_sql() + "\n" + _HSQL)
def q_host_snapshot(spark, d):
    return _snap(spark, d).select(*_hcols())


@query("host_filter_status", _snapshot_sql(60_000_000) + "\n" + _HSQL + " WHERE status <> 'up'")
def q_host_filter_status(spark, d):
    return ho.host_filter_status(_snap(spark, d, "1m"), "down").select(*_hcols())


@query("host_filter_text", _snapshot_sql() + "\n" + _HSQL + " WHERE contains(lower(instance), 'host-1')")
def q_host_filter_text(spark, d):
    return ho.host_filter_text(_snap(spark, d), "  HOST-1 ").select(*_hcols())


@query("host_filter_risk", _snapshot_sql() + "\n" + _HSQL + " WHERE cpu >= 80 OR memory >= 85")
def q_host_filter_risk(spark, d):
    h = _snap(spark, d)
    return ho.host_filter_risk(h, "high_cpu").unionByName(ho.host_filter_risk(h, "high_memory")).distinct().select(*_hcols())


@query("host_filter_group", _snapshot_sql(LB, "host_group_members") + "\n" + _HSQL
       + " WHERE instance IN (SELECT instance FROM host_group_members WHERE group_id = 2)")
def q_host_filter_group(spark, d):
    return ho.host_filter_group(_snap(spark, d), fx.host_group_members(spark, d), 2).select(*_hcols())


@query("host_list", _snapshot_sql(LB, "host_group_members") + "\n" + _HSQL
       + " WHERE instance IN (SELECT instance FROM host_group_members WHERE group_id = 1) AND status = 'up'"
       " AND contains(lower(instance), 'host') ORDER BY cpu DESC, instance")
def q_host_list(spark, d):
    h = ho.host_list(_snap(spark, d), fx.host_group_members(spark, d), status="up", q="host", group_id=1,
                     sort="cpu_desc")
    return h.select(*_hcols())


@query("top_hosts", _snapshot_sql() + """
SELECT instance, round(cpu, 6) AS cpu, round(memory, 6) AS memory, round(greatest(cpu, memory), 6) AS peak
FROM hosts ORDER BY greatest(cpu, memory) DESC, instance LIMIT 12""")
def q_top_hosts(spark, d):
    t = ho.top_hosts(_snap(spark, d), 12)
    return t.select("instance", R6("cpu").alias("cpu"), R6("memory").alias("memory"), R6("peak").alias("peak"))


@query("host_risk", _snapshot_sql() + """
SELECT CASE WHEN cpu >= 80 AND memory >= 85 THEN 'both' WHEN cpu >= 80 THEN 'cpu' WHEN memory >= 85 THEN 'memory'
            ELSE 'normal' END AS risk, count(*) AS n FROM hosts GROUP BY ALL""")
def q_host_risk(spark, d):
    return ho.host_risk_counts(_snap(spark, d))


@query("host_band", _snapshot_sql() + """
SELECT instance, CASE WHEN cpu >= 80 THEN 'danger' WHEN cpu > 60 THEN 'warning' ELSE 'normal' END AS cpu_band,
       CASE WHEN memory >= 85 THEN 'danger' WHEN memory > 70 THEN 'warning' ELSE 'normal' END AS memory_band
FROM hosts""")
def q_host_band(spark, d):
    return ho.host_band(_snap(spark, d)).select("instance", "cpu_band", "memory_band")


@query("group_members", with_views("host_groups", "host_group_members") + """
SELECT g.id, g.name, g.description, CAST(count(m.instance) AS BIGINT) AS member_count,
       array_to_string(list_sort(list(m.instance) FILTER (WHERE m.instance IS NOT NULL)), ',') AS members
FROM host_groups g LEFT JOIN host_group_members m ON m.group_id = g.id GROUP BY g.id, g.name, g.description""")
def q_group_members(spark, d):
    g = ho.group_members(fx.host_groups(spark, d), fx.host_group_members(spark, d))
    return g.select("id", "name", "description", "member_count", F.array_join("members", ",").alias("members"))


def _raw_members(spark, d):
    m = fx.host_group_members(spark, d).join(fx.host_groups(spark, d).select(F.col("id").alias("group_id"), "name"),
                                             "group_id")
    padded = m.withColumn("instance", F.when(F.col("id") % 2 == 1, F.concat(F.lit("  "), "instance", F.lit(" ")))
                          .otherwise(F.col("instance")))
    dup = m.withColumn("id", F.col("id") + 100)
    return padded.unionByName(dup)


@query("group_normalise", with_views("host_groups", "host_group_members") + """,
m AS (SELECT h.*, g.name FROM host_group_members h JOIN host_groups g ON g.id = h.group_id),
raw AS (SELECT id, group_id, CASE WHEN group_id = 3 THEN repeat('n', 129) ELSE name END AS name,
               CASE WHEN id % 2 = 1 THEN chr(9) || '  ' || instance || ' ' || chr(10) ELSE instance END AS instance FROM m
        UNION ALL SELECT id + 100, group_id, CASE WHEN group_id = 3 THEN repeat('n', 129) ELSE name END, instance FROM m),
bad AS (SELECT group_id, max(CASE WHEN group_id = 3 THEN 'name must be 1-128 characters' END) AS reason FROM raw GROUP BY ALL),
t AS (SELECT id, group_id, name, regexp_replace(instance, '^\\s+|\\s+$', '', 'g') AS instance FROM raw)
SELECT id, group_id, name, instance, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id, instance ORDER BY id) AS r FROM t) JOIN bad USING (group_id) WHERE r = 1""")
def q_group_normalise(spark, d):
    raw = _raw_members(spark, d)
    raw = raw.withColumn("name", F.when(F.col("group_id") == 3, F.repeat(F.lit("n"), 129)).otherwise(F.col("name")))
    raw = raw.withColumn("instance", F.when((F.col("id") % 2 == 1) & (F.col("id") < 100), F.concat(F.lit("\t"), "instance", F.lit("\n")))
                         .otherwise(F.col("instance")))
    return ho.group_normalise(raw).select("id", "group_id", "name", "instance", "reason")


@query("host_status_changes", with_views("samples") + f", {_GRID}, "
       "sel AS (SELECT * FROM samples WHERE metric IN ('cpu_usage_percent', 'memory_usage_percent') "
       "OR (metric = 'up' AND labels LIKE '%job=probe%')), "
       f"lk AS ({_LOOKUP.replace(str(LB), '60000000').format(src='sel')})" + """,
snap AS (SELECT instance, eval_us,
                CASE WHEN max(value) FILTER (WHERE metric = 'up') IS NULL THEN 'unknown'
                     WHEN max(value) FILTER (WHERE metric = 'up') >= 1 THEN 'up' ELSE 'down' END AS status
         FROM lk GROUP BY ALL),
ch AS (SELECT instance, lag(status) OVER (PARTITION BY instance ORDER BY eval_us) AS old_status, status AS new_status,
              eval_us AS changed_us FROM snap)
SELECT * FROM ch WHERE old_status IS NOT NULL AND old_status <> new_status""")
def q_host_status_changes(spark, d):
    snaps = ho.host_snapshots_over_time(fx.samples(spark, d), T0, END, "1m", "1m")
    return ho.host_status_changes(snaps)
