"""Registered queries: Structured Streaming twins (§2.11).

Each query receives its input in time slices (``Replay``): after every slice it runs to the
end of its input, stops, and starts again from its checkpoint with the next one. It writes
through a checkpointed sink and returns the sink's content or its state. Oracles are the batch
semantics computed by DuckDB.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vigil.functions.labels import label_text
from vigil.plans.fixture_sql import with_views
from vigil.plans.q_alerts import _ACTIVE, _ACTIVE_COLS, _ACTIVE_SQL, _ACC, _WEB, TTL5, _dedupe_sql, _rec
from vigil.plans.q_hosts import _HSQL, _hcols, _snapshot_sql
from vigil.plans.q_rules import _EVAL, TICK
from vigil.plans.q_series import END, T0
from vigil.plans.q_sources import _OUTCOME_CTE, cri_lines, event_messages
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources import parsers as ps
from vigil.sources import sinks as sk
from vigil.sources import topic as tp
from vigil.streaming import evaluation as ev
from vigil.streaming import jobs as sj
from vigil.streaming.tables import VersionedTable


def _alert_run(spark, d, ttl="5m", then=None):
    """De-duplicate the alert events slice by slice; ``then(root)`` gives a job to run after each slice."""
    r = sj.Replay(spark, fx.alerts(spark, d), "received_us", "alerts")
    out = sj.dedupe_stream(r.stream, ttl)
    after = None

    def run():
        nonlocal after
        sj.run_available_now(out, f"{r.root}/out", f"{r.root}/ck")
        if then is not None:
            after = after or then(r.root, sj.file_stream(spark, f"{r.root}/out", sj.SEEN_OUT, None))
            after()

    r.each(run)
    return r.root, spark.read.parquet(f"{r.root}/out")


@query("stream_dedupe", _rec(with_views("alerts")) + _dedupe_sql(TTL5) + """
SELECT event_id, accepted FROM ded""")
def q_stream_dedupe(spark, d):
    _, out = _alert_run(spark, d)
    return out.select("event_id", "accepted")


def _active_job(root, seen):
    edges = sj.active_stream(seen)
    return lambda: sj.run_available_now(edges, f"{root}/edges", f"{root}/ck-active")


@query("stream_active", _ACTIVE + "\n" + _ACTIVE_SQL)
def q_stream_active(spark, d):
    root, _ = _alert_run(spark, d, then=_active_job)
    return sj.active_state(spark, f"{root}/ck-active").select(*_ACTIVE_COLS)


#: The slice of ``Replay`` in which an event arrives.
_SLICE = """,
bounds AS (SELECT min(received_us) AS lo, max(received_us) + 1 AS hi FROM alerts),
slices AS (SELECT unnest([0, 1, 2, 3]) AS slice),
placed AS (SELECT acc.*, least((received_us - lo) * 4 // (hi - lo), 3) AS at_slice FROM acc, bounds)"""


def _tables_by_slice(spark, d, ttl, table, maintain):
    """The table as it is after each slice."""
    kept, after = [], {}

    def job(root, seen):
        after["table"] = table(spark, f"{root}/table")

        def run():
            sj.run_foreach_batch(seen, maintain(after["table"]), f"{root}/ck-table", mode="append")
            kept.append(after["table"].before(None))

        return run

    _alert_run(spark, d, ttl, then=job)
    out = None
    for i, version in enumerate(kept):
        rows = after["table"].read(version).withColumn("slice", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("stream_active_table", _ACC + _SLICE + """,
newest AS (SELECT slice, placed.*, row_number() OVER (PARTITION BY slice, fingerprint ORDER BY received_us DESC, event_id DESC) AS r
           FROM slices JOIN placed ON at_slice <= slice)
SELECT slice, """ + ", ".join(_ACTIVE_COLS) + """ FROM newest WHERE r = 1 AND status = 'firing'""")
def q_stream_active_table(spark, d):
    """The active set as a table that readers can query, after each slice of the stream."""
    return _tables_by_slice(spark, d, "5m", sj.active_table, sj.maintain_active).filter("status = 'firing'").select("slice", *_ACTIVE_COLS)


@query("stream_ring", _WEB + _SLICE + """,
newest AS (SELECT slice, placed.*, row_number() OVER (PARTITION BY slice ORDER BY received_us DESC, event_id DESC) AS r
           FROM slices JOIN placed ON at_slice <= slice)
SELECT slice, event_id, fingerprint, status, severity, received_us FROM newest WHERE r <= 200""")
def q_stream_ring(spark, d):
    """The list of the newest 200 events after each slice."""
    return _tables_by_slice(spark, d, "24h", sj.ring_table, sj.maintain_ring).select("slice", "event_id", "fingerprint", "status", "severity", "received_us")


@query("stream_active_edges", _ACC + """,
p AS (SELECT *, lag(status) OVER (PARTITION BY fingerprint ORDER BY received_us, event_id) AS before FROM acc)
SELECT fingerprint, event_id, CASE WHEN status = 'firing' AND before = 'firing' THEN 'updated' WHEN status = 'firing' THEN 'added'
                                   WHEN before = 'firing' THEN 'removed' END AS edge FROM p""")
def q_stream_active_edges(spark, d):
    root, _ = _alert_run(spark, d, then=_active_job)
    return spark.read.parquet(f"{root}/edges").select("fingerprint", "event_id", "edge")


@query("stream_stats", _ACC + """
SELECT coalesce(nullif(trim(alertname), ''), fingerprint) AS key, count(*) AS n FROM acc WHERE status = 'firing'
GROUP BY ALL""")
def q_stream_stats(spark, d):
    def job(root, seen):
        def write(batch, batch_id):  # complete mode: each batch is the whole (small) table
            batch.write.mode("overwrite").parquet(f"{root}/stats")

        stats = sj.stats_stream(seen)
        return lambda: sj.run_foreach_batch(stats, write, f"{root}/ck-stats", mode="complete")

    root, _ = _alert_run(spark, d, then=job)
    return spark.read.parquet(f"{root}/stats")


@query("stream_tumbling", with_views("logs") + """
SELECT t_us // 300000000 * 300000000 AS bucket_us, level, count(*) AS n FROM logs GROUP BY ALL""")
def q_stream_tumbling(spark, d):
    r = sj.Replay(spark, fx.logs(spark, d).drop("ts"), "t_us", "logs")
    sink, counts = f"{r.root}/out", sj.tumbling_stream(r.stream)
    r.each(lambda: sj.run_foreach_batch(counts, sj.idempotent_batches(sink), f"{r.root}/ck", mode="update"))
    rows = spark.read.parquet(sink)
    return (rows.groupBy("bucket_us", "level").agg(F.max_by("n", "batch_id").alias("n")))


@query("stream_sliding_limit", with_views("requests") + """,
r AS (SELECT * REPLACE (CASE WHEN regexp_full_match(route, '/api/v1/hosts/[^/]+/metrics') THEN '/api/v1/hosts/:instance/metrics'
                             ELSE route END AS route) FROM requests WHERE route NOT IN ('/metrics', '/healthz', '/readyz')
        AND (starts_with(route, '/api/') OR starts_with(route, '/ws/'))),
c AS (SELECT event_id,
             count(*) OVER (PARTITION BY client_ip, route ORDER BY t_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)
             - count(*) OVER (PARTITION BY client_ip, route, t_us ORDER BY event_id
                              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS used FROM r)
SELECT event_id, used, used <= 3 AS allowed, CAST(greatest(3 - used, 0) AS BIGINT) AS remaining FROM c""")
def q_stream_sliding_limit(spark, d):
    r = sj.Replay(spark, fx.requests(spark, d), "t_us", "requests")
    used = sj.sliding_limit_stream(r.stream, limit=3)
    r.each(lambda: sj.run_available_now(used, f"{r.root}/out", f"{r.root}/ck"))
    return spark.read.parquet(f"{r.root}/out").select("event_id", "used", "allowed", "remaining")


MINUTE = 60_000_000


def _rule_rows(spark, d):
    """Samples slice by slice -> lookups at 15 s ticks -> ``for`` states and edges; heartbeats close the last ticks."""
    rules = fx.rules(spark)
    names = [r[2] for r in fx.HOST_RULES]
    s = fx.samples(spark, d).filter(F.col("metric").isin(*names)).select("metric", "instance", "series", "labels", "t_us", "value")
    r = sj.Replay(spark, s, "t_us", "rule-samples")
    ticks, states = ev.tick_stream(r.stream, T0, "15s"), None

    def run():
        nonlocal states
        sj.run_available_now(ticks, f"{r.root}/ticks", f"{r.root}/ck-ticks")
        states = states if states is not None else ev.rule_state_stream(sj.file_stream(spark, f"{r.root}/ticks", ev.TICK_OUT, None), rules, END, "15s")
        sj.run_available_now(states, f"{r.root}/states", f"{r.root}/ck-states")

    r.each(run)
    # The first beat lets all ticks of the data pass, the second the ticks of the first.
    r.beat(run, *({"metric": "heartbeat", "series": "heartbeat{}", "t_us": END + m * MINUTE, "value": 1.0} for m in (15, 60)))
    return spark.read.schema(ev.STATE_OUT).parquet(f"{r.root}/states")


@query("stream_rule_for", _EVAL + """
SELECT rule_id, series, eval_us, active_since, state FROM st""")
def q_stream_rule_for(spark, d):
    return _rule_rows(spark, d).filter("state != 'resolved'").select("rule_id", "series", "eval_us", "active_since", "state")


@query("stream_rule_edges", _EVAL + f""",
runs AS (SELECT rule_id, series, active_since, min(eval_us) FILTER (WHERE state = 'firing') AS fired_us, max(eval_us) AS last_us
         FROM st GROUP BY ALL HAVING fired_us IS NOT NULL)
SELECT rule_id, series, active_since, 'firing' AS edge, fired_us AS eval_us FROM runs
UNION ALL SELECT rule_id, series, active_since, 'resolved', last_us + {TICK} FROM runs WHERE last_us + {TICK} <= {END}""")
def q_stream_rule_edges(spark, d):
    """Firing and resolved edges, the resolved ones emitted by timers where nothing follows."""
    return _rule_rows(spark, d).filter(F.col("edge").isNotNull() & (F.col("eval_us") <= END)).select("rule_id", "series", "active_since", "edge", "eval_us")


_NOW = END + 400_000_000


@query("stream_resolve_timeout", with_views("alerts") + f""",
n AS (SELECT *, lead(received_us) OVER (PARTITION BY fingerprint ORDER BY received_us, event_id) AS nx FROM alerts)
SELECT fingerprint, event_id, 'resolved' AS status, starts_us, received_us + {TTL5} AS ends_us, 'alertname=' || alertname || ',instance=' || instance
       || coalesce(',severity=' || severity, '') AS labels
FROM n WHERE status = 'firing' AND coalesce(nx, {_NOW}) - received_us > {TTL5}""")
def q_stream_resolve_timeout(spark, d):
    """Alerts that fell silent, resolved by timers; one heartbeat stands for the time that passes after the last event."""
    a = fx.alerts(spark, d).select("fingerprint", "event_id", "status", "labels", "annotations", "starts_us", "received_us")
    r = sj.Replay(spark, a, "received_us", "silent")
    out = ev.resolve_timeout_stream(r.stream, "5m")
    run = lambda: sj.run_available_now(out, f"{r.root}/out", f"{r.root}/ck")
    r.each(run)
    r.beat(run, {"fingerprint": "heartbeat", "event_id": 0, "status": "resolved", "received_us": _NOW + 10 * MINUTE})
    rows = spark.read.schema(out.schema).parquet(f"{r.root}/out").filter(F.col("ends_us") < _NOW)
    return rows.select("fingerprint", "event_id", "status", "starts_us", "ends_us", label_text("labels").alias("labels"))


@query("stream_exactly_once_sink", with_views("alerts") + """
SELECT event_id, fingerprint, status, starts_us, ends_us, received_us FROM alerts""")
def q_stream_exactly_once_sink(spark, d):
    """The sink fails after writing its second batch; the query starts again from its checkpoint,
    replays the batch and every row is there once."""
    r = sj.Replay(spark, fx.alerts(spark, d), "received_us", "alerts-once")
    sink, rows = f"{r.root}/out", r.stream.select("event_id", "fingerprint", "status", "starts_us", "ends_us", "received_us")
    write = sj.idempotent_batches(sink, fail_once=1)

    def run():
        try:
            sj.run_foreach_batch(rows, write, f"{r.root}/ck", mode="append")
        except StreamingQueryException:
            sj.run_foreach_batch(rows, write, f"{r.root}/ck", mode="append")

    r.each(run)
    return spark.read.parquet(sink).drop("batch_id")


@query("stream_bad_records", with_views("alerts") + _OUTCOME_CTE + """
SELECT outcome, count(*) AS n FROM o GROUP BY ALL""")
def q_stream_bad_records(spark, d):
    """Corrupt messages are counted and routed to a quarantine table, never blocking."""
    msgs = event_messages(spark, d).withColumn("_o", F.col("event_id"))
    r = sj.Replay(spark, msgs, "_o", "topic")
    good, bad = f"{r.root}/good", f"{r.root}/bad"
    parsed = ps.parse_alert_events(r.stream.drop("_o"))
    r.each(lambda: sj.run_foreach_batch(parsed, lambda b, i: sj.split_bad_records(b, good, bad, i), f"{r.root}/ck", mode="append"))
    g = spark.read.parquet(good).select("outcome")
    b = spark.read.parquet(bad).select("outcome")
    return g.unionByName(b).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("stream_topic", with_views("alerts") + _OUTCOME_CTE + """
SELECT CASE WHEN NOT broken AND NOT no_fp THEN fingerprint END AS fingerprint, CASE WHEN NOT broken THEN CASE WHEN no_st THEN 'pending' ELSE status END END AS status,
       CASE WHEN NOT broken THEN starts_us END AS starts_us, CASE WHEN NOT broken THEN received_us END AS received_us, outcome FROM o""")
def q_stream_topic(spark, d):
    """A partitioned topic read by offsets from the earliest on, while it grows; the sink fails once between its write and the commit."""
    msgs = event_messages(spark, d).withColumn("third", F.pmod("event_id", F.lit(3)))
    root = sj.scratch(spark, "topic")
    write, stream = sj.idempotent_batches(f"{root}/out", fail_once=1), None
    for k in range(3):
        tp.append_messages(msgs.filter(F.col("third") == k), f"{root}/messages", partitions=3)
        if stream is None:
            stream = ps.src_alert_events(spark, f"{root}/messages", streaming=True).select("fingerprint", "status", "starts_us", "received_us", "outcome")
        for attempt in (1, 2):
            try:
                sj.run_foreach_batch(stream, write, f"{root}/ck", mode="append")
                break
            except StreamingQueryException:
                if attempt == 2:
                    raise
    return spark.read.parquet(f"{root}/out").drop("batch_id")


@query("stream_cri_logs", with_views("logs") + """
SELECT t_us, level, msg, CASE WHEN event_id % 47 <> 0 THEN status END AS status, service FROM logs""")
def q_stream_cri_logs(spark, d):
    """Container lines slice by slice, in the order of their numbers; times of a file may go back by the data's 72 minutes."""
    r = sj.Replay(spark, cri_lines(spark, d), "line_no", "cri")
    parsed = ps.src_cri_logs(r.stream, delay="2 hours").select("t_us", "level", "msg", "status", "service")
    r.each(lambda: sj.run_available_now(parsed, f"{r.root}/out", f"{r.root}/ck"))
    return spark.read.schema(parsed.schema).parquet(f"{r.root}/out")


@query("stream_samples_copy", with_views("samples") + """
SELECT strftime(make_timestamp(t_us), '%Y-%m-%d') AS day, metric, series, t_us, round(value, 6) AS value FROM samples""")
def q_stream_samples_copy(spark, d):
    """The long-term copy of samples, written by the stream form of the sink."""
    r = sj.Replay(spark, fx.samples(spark, d), "t_us", "samples-copy")
    r.each(lambda: sk.sink_samples(r.stream, f"{r.root}/out", f"{r.root}/ck").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{r.root}/out").select(F.col("day").cast("string").alias("day"), "metric", "series", "t_us", F.round("value", 6).alias("value"))


@query("stream_events_published", with_views("alerts") + """
SELECT fingerprint, status, starts_us, ends_us, received_us, 'processed' AS outcome FROM alerts""")
def q_stream_events_published(spark, d):
    """Alert events published from a stream as message files, and read back as a stream."""
    r = sj.Replay(spark, fx.alerts(spark, d), "received_us", "published")
    topic = f"{r.root}/topic"
    r.each(lambda: sk.sink_alert_events(r.stream, topic, checkpoint=f"{r.root}/ck").trigger(availableNow=True).start().awaitTermination())
    back = ps.src_alert_events(spark, topic, streaming=True).select("fingerprint", "status", "starts_us", "ends_us", "received_us", "outcome")
    sj.run_available_now(back, f"{r.root}/back", f"{r.root}/ck-back")
    return spark.read.schema(back.schema).parquet(f"{r.root}/back")


@query("stream_snapshot", _snapshot_sql() + "\n" + _HSQL)
def q_stream_snapshot(spark, d):
    """The newest values per series at a processing-time trigger, as versions that a reader sees whole."""
    r = sj.Replay(spark, fx.samples(spark, d).drop("series"), "t_us", "samples")
    newest = sj.latest_per_series_stream(r.stream)
    latest = VersionedTable(spark, f"{r.root}/latest", newest.schema)

    def write(batch, batch_id):
        latest.replace(batch, batch_id)
        latest.vacuum(keep=2)

    r.each(lambda: sj.run_periodic(newest, write, f"{r.root}/ck", every="1 second"))
    return sj.snapshot_from_latest(latest.read(), END).select(*_hcols())
