"""Hand-made edge frames for the semantics traps (FIXTURES.md §C, SURVEY §8)."""

from pyspark.sql import functions as F

from vigil.functions.timeutil import dur_us
from vigil.operators import alerts as al
from vigil.operators import histogram as hist
from vigil.operators import hosts as ho
from vigil.operators import logs as lg
from vigil.operators import rules as ru
from vigil.operators import series as sr
from vigil.operators.scans import greedy_ttl_accept, keyed_lag, keyed_running_sum, sliding_count

S = 1_000_000


def _samples(spark, rows):
    df = spark.createDataFrame(rows, "metric string, instance string, t_us long, value double, event_id long")
    return (df.withColumn("labels", F.create_map(F.lit("instance"), "instance", F.lit("job"), F.lit("probe")))
            .withColumn("series", F.concat("metric", F.lit("{"), "instance", F.lit("}"))))


def test_counter_resets(spark):
    raw = spark.createDataFrame([("a", 1 * S, 1, 0.0), ("a", 2 * S, 2, 5.0), ("a", 2 * S, 3, 7.0),
                                 ("a", 3 * S, 4, 2.0), ("a", 4 * S, 5, 4.0)],
                                "k string, t_us long, event_id long, value double")
    out = {r.event_id: (r.total, r.was_reset) for r in sr.counter_accumulate(raw, ["k"]).collect()}
    assert out == {1: (0.0, False), 2: (5.0, False), 3: (7.0, False), 4: (9.0, True), 5: (11.0, False)}


def test_keyed_scans_cross_buckets(spark):
    rows = [("x", t * 1000 * S, t) for t in range(10)]
    df = spark.createDataFrame(rows, "k string, t_us long, event_id long").withColumn("v", F.lit(1))
    lag = {r.event_id: r.prev_event_id for r in keyed_lag(df, ["k"], "t_us", "event_id", ["event_id"],
                                                          bucket_us=2500 * S).collect()}
    assert lag == {i: (i - 1 if i else None) for i in range(10)}
    run = {r.event_id: r.n for r in keyed_running_sum(df, ["k"], "t_us", "event_id", "v", "n", bucket_us=2500 * S)
           .collect()}
    assert run == {i: i + 1 for i in range(10)}


def test_lookback_edges(spark):
    at = 1000 * S
    s = _samples(spark, [("cpu", "h", at - 300 * S - 1, 1.0, 1), ("cpu", "h", at - 300 * S, 2.0, 2)])
    v = sr.instant_vector(s, at).collect()
    assert [r.value for r in v] == [2.0]  # exactly t-5m is inside; t-5m-1us is not
    assert sr.instant_vector(s.filter("event_id = 1"), at).count() == 0


def test_rate_needs_two_samples_and_handles_reset(spark):
    s = _samples(spark, [("c", "h", 10 * S, 10.0, 1), ("c", "h", 70 * S, 20.0, 2), ("c", "h", 130 * S, 5.0, 3)])
    r = sr.rate(s, 130 * S, 190 * S, "60s", "5m").orderBy("eval_us").collect()
    assert r[0].eval_us == 130 * S and r[0].value > 0
    one = _samples(spark, [("c", "h", 10 * S, 10.0, 1)])
    assert sr.rate(one, 60 * S, 120 * S, "60s", "5m").count() == 0


def test_histogram_quantile_edges(spark):
    inf = float("inf")
    rows = [(1, 0.1, 10.0), (1, 0.5, 20.0), (1, inf, 20.0),   # normal
            (2, 0.1, 0.0), (2, inf, 0.0),                      # all zero -> NaN
            (3, 0.1, 5.0), (3, 0.5, 6.0),                      # no +Inf -> NaN
            (4, 0.1, 1.0), (4, 0.5, 1.0), (4, inf, 10.0),      # rank in +Inf -> previous bound
            (5, 0.1, 10.0), (5, 0.5, 5.0), (5, inf, 10.0)]     # non-monotone fixed
    b = spark.createDataFrame(rows, "g int, le double, value double")
    q = {r.g: r.value for r in hist.histogram_quantile(b, 0.5, ["g"]).collect()}
    assert abs(q[1] - 0.1) < 1e-9
    assert q[2] != q[2] and q[3] != q[3]
    assert q[4] == 0.5
    assert abs(q[5] - 0.05) < 1e-9


def test_host_snapshot_unknown_and_zero(spark):
    at = 1000 * S
    s = _samples(spark, [("cpu_usage_percent", "only-cpu", at - S, 50.0, 1), ("up", "down", at - S, 0.0, 2)])
    h = {r.instance: r for r in ho.host_snapshot(s, at).collect()}
    assert h["only-cpu"].status == "unknown" and h["only-cpu"].memory == 0.0
    assert h["down"].status == "down" and h["down"].cpu == 0.0
    assert ho.host_filter_status(ho.host_snapshot(s, at), "down").count() == 2  # unknown counts as down
    assert ho.host_filter_text(ho.host_snapshot(s, at), " ONLY ").count() == 1


def test_dedupe_ttl_boundaries(spark):
    ttl = 300 * S
    rows = [(1, 0), (2, ttl - 1), (3, ttl), (4, ttl + 1), (5, ttl + 2), (6, 2 * ttl + 2)]
    df = spark.createDataFrame([(i, "fp", t) for i, t in rows], "event_id long, k string, t long")
    acc = {r.event_id: r.accepted for r in greedy_ttl_accept(df, ["k"], "t", "event_id", ttl).collect()}
    assert acc == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}


def test_dedupe_long_chain_pointer_doubling(spark):
    ttl = 10
    rows = [(i, "k", i * 4) for i in range(200)]  # accepted every 3rd event: 0, 12, 24, ...
    df = spark.createDataFrame(rows, "event_id long, k string, t long")
    acc = {r.event_id for r in greedy_ttl_accept(df, ["k"], "t", "event_id", ttl).filter("accepted").collect()}
    assert acc == set(range(0, 200, 3))


def test_recent_limit_before_filter(spark):
    E = spark.createDataFrame([(i, "firing" if i % 2 else "resolved", i * S) for i in range(20)],
                              "event_id long, status string, received_us long").withColumn(
        "labels", F.create_map(F.lit("severity"), F.lit("warning")))
    assert al.alert_recent(E, 8, status="firing").count() == 4
    assert al.alert_recent(E, "bad").count() == 8
    assert al.alert_recent(E, 10_000).count() == 20


def test_history_status_never_reverts(spark):
    E = spark.createDataFrame(
        [(1, "fp", "resolved", 10, 50, 100), (2, "fp", "firing", 10, None, 200)],
        "event_id long, fingerprint string, status string, starts_us long, ends_us long, received_us long")
    E = E.withColumn("labels", F.create_map(F.lit("alertname"), F.lit(" A "))).withColumn(
        "annotations", F.create_map().cast("map<string,string>"))
    h = al.alert_history_upsert(E).collect()
    assert len(h) == 1 and h[0].status == "resolved" and h[0].resolved_us == 50
    assert h[0].severity == "warning" and h[0].alert_name == "A" and h[0].id == 1


def test_paging(spark):
    H = spark.range(45).select(F.col("id"), F.col("id").alias("fired_us"), F.lit("firing").alias("status"))
    p3 = al.alert_history_page(H, page=3, page_size=20).collect()
    assert len(p3) == 5 and p3[0].total == 45
    assert al.alert_history_page(H, page=9, page_size=20).count() == 0
    assert al.alert_history_page(H, page=1, page_size=500).count() == 45


def test_rate_limit_window(spark):
    rows = [(1, 0), (2, 60 * S), (3, 60 * S), (4, 60 * S + 1)]
    R = spark.createDataFrame([(i, "ip", "/api/x", t) for i, t in rows],
                              "event_id long, client_ip string, route string, t_us long")
    used = {r.event_id: r.used for r in lg.ratelimit_audit(R, limit=2).collect()}
    assert used == {1: 1, 2: 2, 3: 3, 4: 3}
    skipped = R.withColumn("route", F.lit("/metrics"))
    assert lg.ratelimit_audit(skipped).count() == 0


def test_sliding_count_exact_vs_bruteforce(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.choice("ab"), rnd.randrange(0, 500)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, k string, t_us long")
    got = {r.event_id: r.used for r in sliding_count(df, ["k"], "t_us", "event_id", 50).collect()}
    for i, k, t in rows:
        exp = sum(1 for j, k2, t2 in rows if k2 == k and t - 50 <= t2 <= t and (t2 < t or (t2 == t and j <= i)))
        assert got[i] == exp


def test_durations(spark):
    df = spark.createDataFrame([(x,) for x in ["2m", "1h30m", "5ms", "0m", "1h0m", "m", ""]], "d string")
    ok = {r.d: r.v for r in df.select("d", ru.duration_valid(F.col("d")).alias("v")).collect()}
    assert ok == {"2m": True, "1h30m": True, "5ms": True, "0m": False, "1h0m": False, "m": False, "": False}
    ms = {r.d: r.ms for r in df.filter(ru.duration_valid(F.col("d"))).select("d", ru.duration_ms(F.col("d")).alias("ms"))
          .collect()}
    assert ms == {"2m": 120_000, "1h30m": 5_400_000, "5ms": 5}
    assert dur_us("1h30m") == 5_400 * S


def test_rules_validate_traps(spark):
    rules = spark.createDataFrame([
        (1, "ok", "up == 0", "", "", "", None),
        (2, "sub", "max_over_time(x[5m:1m]) > 1", "2m", "warning", "", True),
        (3, "forbidden", "SCRAPE_INTERVAL > 1", "2m", "warning", "", True),
        (4, "long", "a" * 2049, "2m", "warning", "", True),
        (5, "é" * 65, "x", "2m", "warning", "", True),
    ], "id long, name string, expr string, duration string, severity string, summary string, enabled boolean")
    r = {x.id: x for x in ru.rules_validate(rules.withColumn("description", F.lit(""))).collect()}
    assert r[1].valid and r[1].duration == "2m" and r[1].severity == "warning" and r[1].enabled
    assert r[2].reason == "expr subquery is not allowed"
    assert r[3].reason == "expr contains forbidden reference"
    assert r[4].reason == "expr too long"
    assert r[5].reason == "name must be 1-128 characters"  # 130 bytes


def test_envelope_rejection(spark):
    from vigil.sources.parsers import src_webhook
    good = '{"alerts":[{"status":"firing","fingerprint":"a","startsAt":"2024-01-01T00:00:00Z","endsAt":"0001-01-01T00:00:00Z"},{"status":"weird","fingerprint":""}]}'
    bad = '{"alerts":[{"status":"firing","fingerprint":"b"},{"status":"weird","fingerprint":"c"}]}'
    df = spark.createDataFrame([(good, 1), (bad, 2), ('{"alerts":[]}', 3), ("{corrupt", 4)], "body string, received_us long")
    out = src_webhook(df).collect()
    assert [(r.fingerprint, r.ends_us) for r in out] == [("a", None)]


def test_cri_partial_lines(spark):
    from vigil.sources.parsers import src_cri_logs
    lines = [("f", 1, '2024-01-01T00:00:00Z stdout P {"level":"info",'),
             ("f", 2, '2024-01-01T00:00:01Z stdout F "msg":"hello"}'),
             ("f", 3, "2024-01-01T00:00:02Z stderr F not json")]
    out = src_cri_logs(spark.createDataFrame(lines, "file string, line_no long, value string")).orderBy("line_no").collect()
    assert out[0].msg == "hello" and out[0].level == "info"
    assert out[1].raw == "not json" and out[1].stream == "stderr"


def test_redaction(spark):
    df = spark.createDataFrame([("x", "password=hunter2 and Authorization: Bearer abc.def"), ("y", "fine")],
                               "msg string, error string")
    r = {x.msg: x for x in lg.log_redact(df).collect()}
    assert "hunter2" not in r["x"].error and "abc.def" not in r["x"].error and r["x"].redacted
    assert not r["y"].redacted


def test_agg_all_empty_vector_gives_no_row(spark):
    s = _samples(spark, [("cpu", "h", 1 * S, 1.0, 1)]).filter("false")
    g = sr.range_vector_grid(s, 0, 60 * S, "60s")
    assert sr.agg_all(g, "sum").count() == 0


def test_rate_step_summaries_match_sample_level(spark):
    """Summary-per-step rate stats equal the sample-level stats, with many samples exactly
    on grid points (the closed left edge of a window) and counter resets."""
    import random
    from vigil.operators.scans import keyed_lag

    rnd = random.Random(11)
    step, win, start = 10 * S, 30 * S, 100 * S
    rows, eid = [], 0
    for series in ("a", "b"):
        v = 0.0
        for t in sorted(set(rnd.choice([start + rnd.randrange(-40, 200) * S // 2, start + rnd.randrange(-4, 20) * step])
                            for _ in range(120))):
            v = v + rnd.random() * 10 if rnd.random() > 0.15 else rnd.random()
            eid += 1
            rows.append(("c", series, t, v, eid))
    s = _samples(spark, rows)
    end = start + 20 * step
    fast = sr._window_stats(s, start, end, step, win)
    lagged = keyed_lag(s.filter((F.col("t_us") >= start - win) & (F.col("t_us") <= end)), ["series"], "t_us",
                       "event_id", ["value"])
    slow = sr._window_stats_samples(lagged, start, end, step, win)
    cols = ["series", "eval_us", "n", "first_us", "last_us", "first_v", "last_v", "resets", "min_v", "max_v", "sum_v"]

    def norm(df):
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())

    assert norm(fast) == norm(slow)
