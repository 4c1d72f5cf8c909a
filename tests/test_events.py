"""Hot keys, wide intervals, day-wise upserts and page indexes of alert events."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import alerts as al
from vigil.operators import routing as rt
from vigil.operators import scans

S = 1_000_000
EVENTS = "event_id long, fingerprint string, status string, labels map<string,string>, annotations map<string,string>, starts_us long, ends_us long, received_us long"


def events(spark, rows):
    """Rows ``(fingerprint, status, severity, received)``."""
    return spark.createDataFrame([(i, f, s, {"alertname": f[0], "instance": "h", **({"severity": v} if v else {})}, {"summary": "s"}, t, t if s == "resolved" else None, t)
                                  for i, (f, s, v, t) in enumerate(rows)], EVENTS)


def test_rank_of_a_hot_client_is_dealt_by_blocks(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(60) * S + rng.choice([0, 0, rng.randrange(S)]), i) for i in range(3000)] + [("cold", i * 7 * S, 5000 + i) for i in range(40)] + [(None, 5, 9000), (None, 5, 9001)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    for block in (None, 1 * S, 977_131, 1000 * S):
        got = {r.i: r.used for r in scans.sliding_count(df, ["k"], "t", "i", 20 * S, block_us=block).collect()}
        want = {}
        for k in {r[0] for r in rows}:
            mine = sorted((t, i) for a, t, i in rows if a == k)
            for n, (t, i) in enumerate(mine):
                want[i] = sum(x >= t - 20 * S for x, _ in mine[:n + 1])
        assert got == want
    # All rows of the hot client lie in three windows; the widest block holds a sixteenth of one.
    block = 20 * S // 16
    largest = df.filter("k = 'hot'").groupBy(F.floor(F.col("t") / block)).count().agg(F.max("count")).first()[0]
    assert largest < 3000 / 16


def uncovered(rows, now, is_source, is_target):
    """Plain: second by second."""
    out = {}
    for i, (f, s, v, t) in enumerate(rows):
        after = [x for j, x in enumerate(rows) if x[0] == f and (x[3], j) > (t, i)]
        before = [x for j, x in enumerate(rows) if x[0] == f and (x[3], j) < (t, i)]
        opens = s == "firing" and (not before or before[-1][1:3] != (s, v))
        if opens and t < now:
            ends = next((x[3] for x in after if x[1:3] != (s, v) and x[3] < now), now)
            out[i] = (f, v, t, min(ends, now))
    src = [x for x in out.values() if is_source(x[1])]
    found = set()
    for i, (f, v, a, b) in out.items():
        run = None
        for x in range(a, b + S, S):
            free = x < b and not (is_target(v) and any(q[0][0] == f[0] and q[2] <= x < q[3] for q in src))
            if free and run is None:
                run = x
            if not free and run is not None:
                found.add((f, i, run, min(x, b)))
                run = None
    return found


@pytest.mark.parametrize("bucket", [5, 60, 100_000])
def test_inhibition_by_intervals(spark, bucket):
    rng = random.Random(3)
    rows = sorted(((rng.choice("ab") + str(rng.randrange(4)), rng.choice(["firing", "firing", "resolved"]), rng.choice(["critical", "warning", "warning", None]), rng.randrange(900) * S)
                   for _ in range(120)), key=lambda r: r[3])
    rows += [("c0", "firing", "critical", 10 * S), ("c1", "firing", "warning", 2 * S), ("c0", "resolved", "critical", 880 * S)]  # across many buckets
    rows.sort(key=lambda r: r[3])
    got = {tuple(r) for r in rt.alert_inhibit_intervals(events(spark, rows), 950 * S, bucket_us=bucket * S).select("fingerprint", "event_id", "start_us", "end_us").collect()}
    assert got == uncovered(rows, 950 * S, lambda v: v == "critical", lambda v: v == "warning")


DAY = 86_400 * S


def test_untouched_days_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "history")

    def files(day):
        return sorted(glob.glob(f"{path}/day={day}/*.parquet"))

    first = [(f"a{k}", "firing", "critical", k * DAY // 2 + k) for k in range(8)] + [("\ta9 \n", "firing", " ", 5)]
    e = events(spark, first)
    assert al.alert_history_upsert_days(e, path) == ["1970-01-01", "1970-01-02", "1970-01-03", "1970-01-04"]
    before = {d: files(d) for d in ("1970-01-01", "1970-01-02", "1970-01-03", "1970-01-04")}
    late = e.filter("fingerprint = 'a2'").withColumns({"event_id": F.lit(100).cast("long"), "status": F.lit("resolved"), "received_us": F.col("received_us") + 9 * DAY,
                                                       "ends_us": F.col("received_us") + 9 * DAY})
    assert al.alert_history_upsert_days(late, path) == ["1970-01-02"]
    assert al.alert_history_upsert_days(late, path) == ["1970-01-02"]  # again: nothing changes
    for d, old in before.items():
        assert (files(d) == old) == (d != "1970-01-02")
    whole = al.alert_history_upsert(e.unionByName(late)).select(*al.HISTORY_COLS)
    assert sorted(map(repr, map(tuple, spark.read.parquet(path).select(*al.HISTORY_COLS).collect()))) == sorted(map(repr, map(tuple, whole.collect())))
    none = e.limit(1).withColumn("starts_us", F.lit(None).cast("long"))
    assert al.alert_history_upsert_days(none, path) == ["none"] and spark.read.parquet(path).count() == whole.count() + 1


def test_pages_by_rank(spark, tmp_path):
    rows = [(f"f{k}", "firing", "info", (k * 37 % 211) // 3 * S) for k in range(211)]
    h = al.alert_history_upsert(events(spark, rows))
    path = str(tmp_path / "index")
    al.alert_history_index(h, path, parts=7)
    for page, size in ((1, 20), (3, 20), (11, 20), (12, 20), (0, 0), (2, 1000), (211, 1)):
        got, want = (x.orderBy(F.col("fired_us").desc(), F.col("id").desc()).collect() for x in (al.alert_history_page_at(spark, path, page, page_size=size),
                                                                                                 al.alert_history_page(h, page=page, page_size=size)))
        assert [tuple(r) for r in got] == [tuple(r[c] for c in got[0].__fields__) for r in want] if want else not got
    deep = al.alert_history_page_at(spark, path, 10, page_size=20)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "part" in plan
    assert "PartitionFilters: [part" in plan
    al.alert_history_index(h.limit(0), str(tmp_path / "none"))
    assert al.alert_history_page_at(spark, str(tmp_path / "none")).count() == 0


def test_as_of_scan_has_a_task_for_so_many_events(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(4000) * S, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    made, real = [], scans._asof_next
    monkeypatch.setattr(scans, "ASOF_ROWS", 60)
    monkeypatch.setattr(scans, "_asof_next", lambda ev, gap, parts: made.append(parts) or real(ev, gap, parts))
    got = {r.id for r in scans.greedy_ttl_accept(df, ["k"], "t", "id", 50 * S).filter("accepted").collect()}
    want, last = set(), {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] > 50 * S:
            last[k] = t
            want.add(i)
    assert got == want and made == [15]


def test_samples_are_put_in_order_by_many_tasks(spark):
    from vigil.operators import series as sr

    s = spark.createDataFrame([("m", "h", "m{}", {"a": "b"}, i * S, float(i % 7), i) for i in range(600)],
                              "metric string, instance string, series string, labels map<string,string>, t_us long, value double, event_id long")
    plan = sr.rate(s, 0, 600 * S, "1m")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [series" in plan and f", {sr.STEP_PARTS}" in plan
