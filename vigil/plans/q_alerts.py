"""Registered queries: alert routing (§2.6) and alert event processing (§2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import alerts as al
from vigil.operators import hosts as ho
from vigil.operators import notify as nt
from vigil.operators import routing as rt
from vigil.plans.fixture_sql import with_views
from vigil.plans.q_hosts import _snapshot_ctes
from vigil.plans.q_series import END, R6, T0
from vigil.plans.registry import query
from vigil.sources import fixtures as fx

TTL5 = 300_000_000
TTL24 = 86_400_000_000
MINUTE = 60_000_000


def _rec(views: str) -> str:
    return views.replace("WITH ", "WITH RECURSIVE ", 1)


def _dedupe_sql(ttl_us: int, src: str = "alerts", out: str = "ded") -> str:
    """Greedy TTL acceptance by recursion over next-pointers (independent of the Spark plan)."""
    return f""",
ev_{out} AS (SELECT *, fingerprint || '|' || status || '|' || CAST(starts_us AS VARCHAR) || '|'
                   || coalesce(CAST(ends_us AS VARCHAR), '~') AS dk FROM {src}),
nx_{out} AS (SELECT e.event_id, (SELECT f.event_id FROM ev_{out} f WHERE f.dk = e.dk
                                  AND f.received_us > e.received_us + {ttl_us}
                                  ORDER BY f.received_us, f.event_id LIMIT 1) AS nxt FROM ev_{out} e),
st_{out} AS (SELECT arg_min(event_id, (received_us, event_id)) AS event_id FROM ev_{out} GROUP BY dk),
acc_{out}(event_id) AS (SELECT event_id FROM st_{out}
                        UNION ALL SELECT n.nxt FROM acc_{out} a JOIN nx_{out} n ON n.event_id = a.event_id
                        WHERE n.nxt IS NOT NULL),
{out} AS (SELECT s.*, s.event_id IN (SELECT event_id FROM acc_{out}) AS accepted FROM {src} s)"""


def _alerts(spark, d):
    return fx.alerts(spark, d)


def _accepted(spark, d, ttl="5m"):
    return al.alert_dedupe_ttl(_alerts(spark, d), ttl).filter("accepted").drop("accepted")


def _web(spark, d):
    """What the event list and the history see: accepted by the 24 h de-duplication."""
    return _accepted(spark, d, "24h")


def _web_sql(*extra: str) -> str:
    return _rec(with_views("alerts", *extra)) + _dedupe_sql(TTL24) + ", acc AS (SELECT * FROM ded WHERE accepted)"


def _acc_sql(*extra: str) -> str:
    return _rec(with_views("alerts", *extra)) + _dedupe_sql(TTL5) + ", acc AS (SELECT * FROM ded WHERE accepted)"


def _active_sql(*extra: str) -> str:
    return _acc_sql(*extra) + _ACTIVE_CTE


_ACTIVE_CTE = """,
active AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY received_us DESC,
                                                                event_id DESC) AS r FROM acc)
           WHERE r = 1 AND status = 'firing')"""
_ACC = _acc_sql()
_WEB = _web_sql()
_ACTIVE = _active_sql()
_ACTIVE_COLS = ["fingerprint", "status", "alertname", "instance", "severity", "starts_us", "received_us", "event_id"]
_ACTIVE_SQL = "SELECT " + ", ".join(_ACTIVE_COLS) + " FROM active"


@query("alert_validate", with_views("alerts") + """,
bad AS (SELECT event_id, CASE WHEN event_id % 89 = 0 THEN '' ELSE fingerprint END AS fingerprint,
               CASE WHEN event_id % 97 = 0 THEN 'pending' ELSE status END AS status FROM alerts)
SELECT event_id,
       CASE WHEN coalesce(fingerprint, '') = '' THEN 'fingerprint is required'
            WHEN status NOT IN ('firing', 'resolved') OR status IS NULL THEN 'unsupported status: ' || coalesce(status, '')
       END AS reason,
       CASE WHEN coalesce(fingerprint, '') = '' OR status NOT IN ('firing', 'resolved') OR status IS NULL
            THEN 'permanent_error' ELSE 'ok' END AS outcome
FROM bad""")
def q_alert_validate(spark, d):
    a = _alerts(spark, d)
    a = (a.withColumn("fingerprint", F.when(F.col("event_id") % 89 == 0, F.lit("")).otherwise(F.col("fingerprint")))
         .withColumn("status", F.when(F.col("event_id") % 97 == 0, F.lit("pending")).otherwise(F.col("status"))))
    return al.alert_validate(a).select("event_id", "reason", "outcome")


@query("alert_dedupe_ttl", _rec(with_views("alerts")) + _dedupe_sql(TTL5) + """
SELECT event_id, accepted FROM ded""")
def q_alert_dedupe_ttl(spark, d):
    return al.alert_dedupe_ttl(_alerts(spark, d), "5m").select("event_id", "accepted")


@query("alert_dedupe_ttl_web", _rec(with_views("alerts")) + _dedupe_sql(TTL24) + """
SELECT event_id, accepted FROM ded""")
def q_alert_dedupe_ttl_web(spark, d):
    return al.alert_dedupe_ttl(_alerts(spark, d), "24h").select("event_id", "accepted")


@query("alert_active", _ACTIVE + "\n" + _ACTIVE_SQL)
def q_alert_active(spark, d):
    return al.alert_active(_alerts(spark, d), dedupe_first=True).select(*_ACTIVE_COLS)


@query("alert_active_web", with_views("alerts") + """,
active AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY received_us DESC,
                                                                event_id DESC) AS r FROM alerts)
           WHERE r = 1 AND status = 'firing')
""" + _ACTIVE_SQL)
def q_alert_active_web(spark, d):
    return al.alert_active(_alerts(spark, d), dedupe_first=False).select(*_ACTIVE_COLS)


@query("alert_active_list", _ACTIVE + "\n" + _ACTIVE_SQL + " WHERE severity = 'critical' ORDER BY starts_us DESC, fingerprint")
def q_alert_active_list(spark, d):
    a = al.alert_active(_alerts(spark, d))
    return al.alert_active_list(a, "critical").select(*_ACTIVE_COLS)


_EV_COLS = ["event_id", "fingerprint", "status", "severity", "received_us"]


@query("alert_recent", _WEB + """
SELECT event_id, fingerprint, status, severity, received_us FROM (
  SELECT * FROM acc ORDER BY received_us DESC, event_id DESC LIMIT 50) WHERE status = 'firing'""")
def q_alert_recent(spark, d):
    return al.alert_recent(_web(spark, d), 50, status="firing").select(*_EV_COLS)


@query("alert_ring", _WEB + """
SELECT event_id, fingerprint, status, severity, received_us FROM acc ORDER BY received_us DESC, event_id DESC LIMIT 200""")
def q_alert_ring(spark, d):
    return al.alert_ring(_web(spark, d)).select(*_EV_COLS)


@query("alert_stats", _ACC + """
SELECT coalesce(nullif(trim(alertname), ''), fingerprint) AS key, count(*) AS n FROM acc WHERE status = 'firing'
GROUP BY ALL""")
def q_alert_stats(spark, d):
    return al.alert_stats(_alerts(spark, d))


@query("alert_aggregate_key", with_views("alerts") + """
SELECT CASE WHEN trim(coalesce(alertname, '')) <> '' AND trim(coalesce(instance, '')) <> ''
            THEN trim(alertname) || ':' || trim(instance)
            WHEN trim(coalesce(alertname, '')) <> '' THEN trim(alertname) ELSE fingerprint END AS key,
       count(*) AS n FROM alerts GROUP BY ALL""")
def q_alert_aggregate_key(spark, d):
    return al.alert_aggregate_key(_alerts(spark, d))


_LJSON = ("'{\"alertname\":\"' || alertname || '\",\"instance\":\"' || instance || '\"' "
          "|| coalesce(',\"severity\":\"' || severity || '\"', '') || '}'")


@query("alert_history_build", _WEB + f"""
SELECT event_id, fingerprint, trim(alertname) AS alert_name, trim(instance) AS instance,
       coalesce(nullif(trim(coalesce(severity, '')), ''), 'warning') AS severity, status,
       alertname || ' on ' || instance AS summary, {_LJSON} AS labels_json, starts_us AS fired_us,
       CASE WHEN status = 'resolved' THEN ends_us END AS resolved_us, received_us
FROM acc""")
def q_alert_history_build(spark, d):
    return al.alert_history_build(_web(spark, d))


@query("alert_texts_trimmed", with_views("alerts") + """,
t AS (SELECT *, CASE (event_id % 3 + 3) % 3 WHEN 1 THEN '' ELSE alertname END AS name,
             coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN severity ELSE '' END, ''), 'warning') AS sev FROM alerts)
SELECT event_id, name AS alert_name, instance, sev AS severity, alertname || ' on ' || instance AS summary,
       CASE WHEN name <> '' THEN name || ':' || instance ELSE fingerprint END AS group_key FROM t""")
def q_alert_texts_trimmed(spark, d):
    """Tabs, line ends and wide spaces around label values and texts go, as in the stream form."""
    def around(c, *ends):
        return F.concat(F.lit(ends[0]), c, F.lit(ends[1]))

    e, k = _alerts(spark, d), F.pmod("event_id", F.lit(3))
    name = F.when(k == 0, around(F.col("alertname"), "\t", "\n")).when(k == 1, F.lit(" \u2003\r")).otherwise(around(F.col("alertname"), "\u00a0", "\x0b"))
    sev = F.when(F.pmod("event_id", F.lit(2)) == 0, around(F.coalesce("severity", F.lit("")), "\n", " ")).otherwise(F.lit("\t"))
    labels = F.create_map(F.lit("alertname"), name, F.lit("instance"), around(F.col("instance"), "\n\t", "\u3000"), F.lit("severity"), sev)
    e = e.withColumn("labels", labels).withColumn("annotations", F.create_map(F.lit("summary"), around(F.element_at("annotations", F.lit("summary")), "\n", "\t")))
    h = al.alert_history_build(e).select("event_id", "alert_name", "instance", "severity", "summary")
    return h.join(e.select("event_id", al.aggregate_key().alias("group_key")), "event_id")


def _hist_sql(*extra: str) -> str:
    return _web_sql(*extra) + _HIST_CTE


_HIST_CTE = f""",
hb AS (SELECT event_id, fingerprint, trim(alertname) AS alert_name, trim(instance) AS instance,
              coalesce(nullif(trim(coalesce(severity, '')), ''), 'warning') AS severity, status,
              alertname || ' on ' || instance AS summary, {_LJSON} AS labels_json, starts_us AS fired_us,
              CASE WHEN status = 'resolved' THEN ends_us END AS resolved_us, received_us FROM acc),
history AS (
  SELECT arg_min(event_id, (received_us, event_id)) AS id, fingerprint,
         arg_max(alert_name, (received_us, event_id)) AS alert_name, arg_max(instance, (received_us, event_id)) AS instance,
         arg_max(severity, (received_us, event_id)) AS severity,
         CASE WHEN bool_or(status = 'resolved') THEN 'resolved' ELSE arg_min(status, (received_us, event_id)) END AS status,
         arg_max(summary, (received_us, event_id)) AS summary, arg_max(labels_json, (received_us, event_id)) AS labels_json,
         fired_us, arg_max(resolved_us, (received_us, event_id)) FILTER (WHERE status = 'resolved') AS resolved_us,
         min(received_us) AS created_us
  FROM hb GROUP BY fingerprint, fired_us)"""
_HIST = _hist_sql()


@query("alert_history_upsert", _HIST + "\nSELECT * FROM history")
def q_alert_history_upsert(spark, d):
    return al.alert_history_upsert(_web(spark, d)).select(*al.HISTORY_COLS)


@query("alert_history_upsert_all", _HIST.replace("FROM acc),", "FROM alerts),", 1) + "\nSELECT * FROM history")
def q_alert_history_upsert_all(spark, d):
    """Grouped upsert over every delivered event (no de-duplication): 642 rows at sf0.01."""
    return al.alert_history_upsert(_alerts(spark, d)).select(*al.HISTORY_COLS)


@query("alert_history_incremental", _HIST + """
SELECT h.id, h.fingerprint, h.alert_name, h.instance, h.severity, h.status, h.summary, h.labels_json, h.fired_us,
       h.resolved_us, h.created_us FROM history h""")
def q_alert_history_incremental(spark, d):
    """Two-step upsert: the first 30 minutes, then the rest merged into it = one-shot result."""
    acc = _web(spark, d)
    cut = 1_704_069_000_000_000
    first = al.alert_history_upsert(acc.filter(F.col("received_us") < cut))
    return al.alert_history_upsert(acc.filter(F.col("received_us") >= cut), existing=first).select(*al.HISTORY_COLS)


@query("alert_history_page", _hist_sql("host_group_members") + """,
f AS (SELECT * FROM history WHERE severity = 'warning'
        AND instance IN (SELECT instance FROM host_group_members WHERE group_id = 1))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY fired_us DESC, id DESC LIMIT 20 OFFSET 20""")
def q_alert_history_page(spark, d):
    h = al.alert_history_upsert(_web(spark, d)).select(*al.HISTORY_COLS)
    return al.alert_history_page(h, fx.host_group_members(spark, d), severity="warning", group_id=1, page=2,
                                 page_size=20)


@query("alert_history_days", _HIST.replace("FROM acc),", "FROM alerts),", 1) + "\nSELECT * FROM history")
def q_alert_history_days(spark, d):
    """The history as a table by day of firing, folded in three steps over days: only touched days are rewritten."""
    from vigil.streaming.jobs import scratch

    e, path = _alerts(spark, d), scratch(spark, "history-days")
    for low, high in ((0, 20), (20, 45), (45, 10_000)):
        al.alert_history_upsert_days(e.filter((F.col("received_us") >= T0 + low * MINUTE) & (F.col("received_us") < T0 + high * MINUTE)), path)
    return spark.read.parquet(path).select(*al.HISTORY_COLS)


@query("alert_history_deep_page", _HIST.replace("FROM acc),", "FROM alerts),", 1) + """
SELECT *, (SELECT count(*) FROM history) AS total FROM history ORDER BY fired_us DESC, id DESC LIMIT 25 OFFSET 375""")
def q_alert_history_deep_page(spark, d):
    """Page 16 of a stored page index; one or two of its ranges are read."""
    from vigil.streaming.jobs import scratch

    path = scratch(spark, "history-index")
    al.alert_history_index(al.alert_history_upsert(_alerts(spark, d)), path, parts=8)
    return al.alert_history_page_at(spark, path, page=16, page_size=25)


@query("alert_severity_counts", _ACTIVE + """
SELECT coalesce(severity, 'info') AS severity, count(*) AS n FROM active GROUP BY ALL""")
def q_alert_severity_counts(spark, d):
    return al.alert_severity_counts(al.alert_active(_alerts(spark, d)))


@query("alert_outcomes", _rec(with_views("alerts")) + _dedupe_sql(TTL5) + """
SELECT CASE WHEN accepted THEN 'stored' ELSE 'deduped' END AS result, status, count(*) AS n FROM ded GROUP BY ALL""")
def q_alert_outcomes(spark, d):
    return al.alert_outcomes(_alerts(spark, d))


@query("alert_duration", _HIST + """
SELECT alert_name, count(*) AS n, round(avg((resolved_us - fired_us) / 1e6), 6) AS mean_s,
       round(quantile_cont((resolved_us - fired_us) / 1e6, 0.5), 6) AS median_s,
       round(max((resolved_us - fired_us) / 1e6), 6) AS max_s
FROM history WHERE resolved_us IS NOT NULL GROUP BY ALL""")
def q_alert_duration(spark, d):
    r = al.alert_duration(al.alert_history_upsert(_web(spark, d)))
    return r.select("alert_name", "n", R6("mean_s").alias("mean_s"), R6("median_s").alias("median_s"),
                    R6("max_s").alias("max_s"))


# ------------------------------------------------------------------ routing

@query("fingerprint", with_views("alerts") + """
SELECT event_id, md5('alertname=' || alertname || ',instance=' || instance
                     || coalesce(',severity=' || severity, '')) AS label_fp FROM alerts""")
def q_fingerprint(spark, d):
    return rt.fingerprint(_alerts(spark, d), out="label_fp").select("event_id", "label_fp")


@query("alert_groups", _ACTIVE + """,
g AS (SELECT alertname, instance, list_sort(list(DISTINCT fingerprint)) AS m, count(*) AS n_members,
             CASE WHEN bool_or(status = 'firing') THEN 'firing' ELSE 'resolved' END AS status
      FROM active GROUP BY ALL),
sev AS (SELECT alertname, instance, min(severity) AS s, count(severity) AS c, count(DISTINCT severity) AS dc
        FROM active GROUP BY ALL)
SELECT g.alertname, g.instance, array_to_string(g.m, ',') AS members, g.n_members, g.status,
       'alertname=' || g.alertname || ',instance=' || g.instance
         || CASE WHEN sev.c = g.n_members AND sev.dc = 1 THEN ',severity=' || sev.s ELSE '' END AS common_labels
FROM g JOIN sev USING (alertname, instance)""")
def q_alert_groups(spark, d):
    from vigil.functions.labels import label_text
    g = rt.alert_groups(al.alert_active(_alerts(spark, d)))
    return g.select("alertname", "instance", F.array_join("members", ",").alias("members"), "n_members", "status",
                    label_text("common_labels").alias("common_labels"))


@query("alert_inhibit", with_views("alerts") + """,
active AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY received_us DESC,
                                                                event_id DESC) AS r FROM alerts)
           WHERE r = 1 AND status = 'firing'),
src AS (SELECT DISTINCT alertname, instance FROM active WHERE severity = 'critical')
SELECT fingerprint, alertname, instance, severity FROM active a
WHERE severity IS DISTINCT FROM 'warning'
   OR NOT EXISTS (SELECT 1 FROM src WHERE src.alertname = a.alertname AND src.instance = a.instance)""")
def q_alert_inhibit(spark, d):
    a = al.alert_active(_alerts(spark, d), dedupe_first=False)
    return rt.alert_inhibit(a).select("fingerprint", "alertname", "instance", "severity")


def _intervals_sql(now_us: int) -> str:
    return f""",
p AS (SELECT *, lag(status) OVER w AS before, lag(coalesce(severity, '~')) OVER w AS before_sev FROM alerts WHERE received_us < {now_us}
      WINDOW w AS (PARTITION BY fingerprint ORDER BY received_us, event_id)),
c AS (SELECT *, coalesce(lead(received_us) OVER (PARTITION BY fingerprint ORDER BY received_us, event_id), {now_us}) AS nx
      FROM p WHERE before IS NULL OR before <> status OR before_sev <> coalesce(severity, '~')),
iv AS (SELECT fingerprint, event_id, alertname, instance, severity, received_us AS s, nx AS e FROM c WHERE status = 'firing' AND received_us < nx),
src AS (SELECT alertname, instance, s, e FROM iv WHERE severity = 'critical'),
cuts AS (SELECT fingerprint, event_id, alertname, instance, s AS cut_us, e FROM iv WHERE severity = 'warning'
         UNION SELECT t.fingerprint, t.event_id, t.alertname, t.instance, unnest([x.s, x.e]), t.e
               FROM iv t JOIN src x ON x.alertname = t.alertname AND x.instance = t.instance AND x.s < t.e AND x.e > t.s WHERE t.severity = 'warning'),
seg AS (SELECT k.*, lead(k.cut_us, 1, k.e) OVER (PARTITION BY k.event_id ORDER BY k.cut_us) AS until
        FROM cuts k JOIN iv t USING (event_id) WHERE k.cut_us >= t.s AND k.cut_us < k.e)
SELECT fingerprint, event_id, s AS start_us, e AS end_us FROM iv WHERE severity IS DISTINCT FROM 'warning'
UNION ALL SELECT fingerprint, event_id, cut_us, until FROM seg
WHERE NOT EXISTS (SELECT 1 FROM src x WHERE x.alertname = seg.alertname AND x.instance = seg.instance AND x.s <= seg.cut_us AND x.e >= seg.until)"""


@query("alert_inhibit_intervals", with_views("alerts") + _intervals_sql(END + 400_000_000))
def q_alert_inhibit_intervals(spark, d):
    return rt.alert_inhibit_intervals(_alerts(spark, d), END + 400_000_000, bucket_us=300_000_000)


@query("alert_resolve_timeout", with_views("alerts") + f""",
n AS (SELECT *, lead(received_us) OVER (PARTITION BY fingerprint ORDER BY received_us, event_id) AS nx FROM alerts)
SELECT fingerprint, event_id, received_us + {TTL5} AS ends_us FROM n
WHERE status = 'firing' AND coalesce(nx, {END + 400_000_000}) - received_us > {TTL5}""")
def q_alert_resolve_timeout(spark, d):
    r = rt.alert_resolve_timeout(_alerts(spark, d), END + 400_000_000, "5m")
    return r.select("fingerprint", "event_id", "ends_us")


def _notify_sql(views: str, now_us: int, wait: int, every: int, repeat: int) -> str:
    """The lives of every group by recursion (start of the life -> start of the next), then flushes and repeats."""
    again = -(-repeat // every) * every
    return _rec(views) + f""",
p AS (SELECT *, lag(status) OVER (PARTITION BY fingerprint ORDER BY received_us, event_id) AS before FROM alerts),
e AS (SELECT alertname, instance, fingerprint, status, received_us, event_id,
             sum(CASE WHEN status = 'firing' THEN 1 WHEN before = 'firing' THEN -1 ELSE 0 END)
               OVER (PARTITION BY alertname, instance ORDER BY received_us, event_id ROWS UNBOUNDED PRECEDING) AS firing
      FROM p WHERE before IS DISTINCT FROM status),
m AS (SELECT alertname, instance, received_us AS a, arg_max(firing, event_id) AS firing,
             lead(received_us) OVER (PARTITION BY alertname, instance ORDER BY received_us) AS b
      FROM e GROUP BY alertname, instance, received_us),
quiet AS (SELECT alertname, instance, a, b FROM m WHERE firing = 0 AND b IS NOT NULL),
lives(alertname, instance, start) AS (
  SELECT alertname, instance, min(received_us) FROM e GROUP BY alertname, instance
  UNION ALL
  SELECT l.alertname, l.instance, min(q.b) FROM lives l JOIN quiet q ON q.alertname = l.alertname AND q.instance = l.instance AND q.b > l.start + {wait}
   WHERE l.start + {wait} + (greatest(q.a - l.start - {wait}, 0) + {every - 1}) // {every} * {every} < q.b
  GROUP BY l.alertname, l.instance),
t AS (SELECT e.*, l.start + {wait} AS origin,
             l.start + {wait} + (greatest(e.received_us - l.start - {wait}, 0) + {every - 1}) // {every} * {every} AS flush_us
      FROM e ASOF JOIN lives l ON e.alertname = l.alertname AND e.instance = l.instance AND e.received_us >= l.start),
members AS (SELECT alertname, instance, origin, flush_us, fingerprint, arg_max(status, (received_us, event_id)) AS status,
                   max((received_us, event_id)) AS last_at, arg_max(firing, (received_us, event_id)) AS firing
            FROM t WHERE flush_us <= {now_us} GROUP BY ALL),
sent AS (SELECT alertname, instance, origin, flush_us, arg_max(firing, last_at) AS n_firing, count(*) FILTER (WHERE status = 'resolved') AS gone
         FROM members GROUP BY ALL),
s AS (SELECT *, lead(flush_us) OVER (PARTITION BY alertname, instance, origin ORDER BY flush_us) AS nx FROM sent)
SELECT alertname, instance, flush_us, CAST(n_firing + gone AS BIGINT) AS n_alerts, CAST(n_firing AS BIGINT) AS n_firing,
       CASE WHEN flush_us = origin THEN 'initial' ELSE 'change' END AS reason FROM s
UNION ALL
SELECT alertname, instance, unnest(range(flush_us + {again}, coalesce(nx, {now_us + 1}), {again})), CAST(n_firing AS BIGINT), CAST(n_firing AS BIGINT), 'repeat'
FROM s WHERE n_firing > 0"""


@query("alert_notify", _notify_sql(with_views("alerts"), END + 400_000_000, 10_000_000, 30_000_000, 14_400_000_000))
def q_alert_notify(spark, d):
    return nt.alert_notify(_alerts(spark, d), END + 400_000_000)


@query("alert_notify_short", _notify_sql(with_views("alerts"), END + 400_000_000, 45_000_000, 20_000_000, 130_000_000))
def q_alert_notify_short(spark, d):
    """A wait longer than the interval, and a repeat that is no multiple of it: repeats occur inside the data's 72 minutes."""
    return nt.alert_notify(_alerts(spark, d), END + 400_000_000, "45s", "20s", "130s", bucket_us=240_000_000)


@query("overview", _active_sql("samples") + _snapshot_ctes() + f"""
SELECT count(*) AS total_hosts, count(*) FILTER (WHERE status = 'up') AS healthy_hosts,
       count(*) FILTER (WHERE status <> 'up') AS down_hosts, (SELECT count(*) FROM active) AS active_alerts,
       round(coalesce(avg(cpu) FILTER (WHERE status = 'up'), 0), 6) AS avg_cpu,
       round(coalesce(avg(memory) FILTER (WHERE status = 'up'), 0), 6) AS avg_memory,
       CAST({END} AS BIGINT) AS generated_us
FROM hosts""")
def q_overview(spark, d):
    h = ho.host_snapshot(fx.samples(spark, d), END)
    o = ho.overview(h, al.alert_active(_alerts(spark, d)), END)
    return o.select("total_hosts", "healthy_hosts", "down_hosts", "active_alerts", R6("avg_cpu").alias("avg_cpu"),
                    R6("avg_memory").alias("avg_memory"), "generated_us")
