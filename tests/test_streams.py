"""Stream operators on small hand-made slices: disorder, timers, replays, versions."""

import glob
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vigil.operators import routing as rt
from vigil.operators import series as sr
from vigil.sources import parsers as ps
from vigil.sources import topic as tp
from vigil.streaming import evaluation as ev
from vigil.streaming import jobs as sj
from vigil.streaming.lines import assembled_lines
from vigil.streaming.tables import KeyedTable, VersionedTable

S = 1_000_000
MIN = 60 * S


def slices(spark, rows, schema, parts, run_of):
    """Rows ``(..., slice)`` written slice by slice; ``run_of(stream, root)`` gives the job to run after each."""
    sj.enable_state_store(spark)
    root = sj.scratch(spark, "slices")
    spark.createDataFrame([], schema).write.parquet(f"{root}/in")
    run = run_of(sj.file_stream(spark, f"{root}/in", spark.createDataFrame([], schema).schema, None), root)
    for k in range(parts):
        spark.createDataFrame([r[:-1] for r in rows if r[-1] == k], schema).write.mode("append").parquet(f"{root}/in")
        run()
    return root


def test_ticks_under_disorder_equal_the_grid(spark):
    rng = random.Random(1)
    schema = "metric string, instance string, series string, labels map<string,string>, t_us long, value double"
    start, rows = 1000 * MIN, []
    for n in range(6):
        t = start - 4 * MIN
        while t < start + 50 * MIN:
            t += rng.choice([1, 7, 15, 40, 400]) * S
            late = rng.randrange(300) * S  # up to 5 minutes late, within the watermark's 10
            rows.append(("m", "h", f"m{{n={n}}}", {"n": str(n)}, t, float(rng.randrange(100)), min(3, max(0, (t + late - start) // (13 * MIN)))))
    rows += [("beat", "", "beat", {}, start + k * MIN, 0.0, 4 + i) for i, k in enumerate((75, 120))]
    root = slices(spark, rows, schema, 6, lambda stream, root: lambda ticks=ev.tick_stream(stream, start, "15s"): sj.run_available_now(ticks, f"{root}/out", f"{root}/ck"))
    got = spark.read.parquet(f"{root}/out").filter(f"metric = 'm' and eval_us <= {start + 55 * MIN}")
    want = sr.range_vector_grid(spark.createDataFrame([r[:-1] for r in rows], schema).filter("metric = 'm'"), start, start + 55 * MIN, "15s")
    cols = ["series", "eval_us", "value", "sample_us"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_rules_that_need_more_are_refused(spark):
    from vigil.plans.q_rules import RATE_RULE
    from vigil.sources import fixtures as fx

    rules = spark.createDataFrame([RATE_RULE], fx.RULE_SCHEMA)
    row = [("m", "h", "s", "{}", 5, 1.0, 5, 0)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ev.TICK_OUT)
    with pytest.raises(StreamingQueryException, match="newest sample"):
        slices(spark, row, schema, 1, lambda stream, root: lambda: sj.run_available_now(ev.rule_state_stream(stream, rules), f"{root}/out", f"{root}/ck"))


def test_silent_alerts_under_disorder(spark):
    rng = random.Random(2)
    schema = "fingerprint string, event_id long, status string, labels map<string,string>, annotations map<string,string>, starts_us long, received_us long"
    rows, now = [], 2000 * MIN
    for i in range(400):
        t = 1000 * MIN + rng.randrange(90) * MIN + rng.choice([0, 0, rng.randrange(MIN)])
        late = rng.randrange(4 * MIN)
        rows.append((f"f{rng.randrange(40)}", i, rng.choice(["firing", "firing", "resolved"]), {"a": "b"}, None, None, t, (t + late - 1000 * MIN) // (32 * MIN)))
    rows.append(("beat", 999, "resolved", None, None, None, now + 10 * MIN, 3))
    root = slices(spark, rows, schema, 4, lambda stream, root: lambda out=ev.resolve_timeout_stream(stream, "5m"): sj.run_available_now(out, f"{root}/out", f"{root}/ck"))
    got = spark.read.parquet(f"{root}/out")
    want = rt.alert_resolve_timeout(spark.createDataFrame([r[:-1] for r in rows[:-1]], schema), now, "5m")
    cols = ["fingerprint", "event_id", "status", "ends_us"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert got.first().labels == {"a": "b"}


def test_lines_cut_by_slices(spark):
    t = "2024-01-01T00:0{}:00Z"
    lines = [("f", 0, f"{t.format(0)} stdout P one ", 0), ("f", 1, f"{t.format(0)} stdout P two ", 0), ("g", 0, f"{t.format(0)} stderr F whole", 0),
             ("f", 2, f"{t.format(1)} stdout F three", 1), ("f", 3, f"{t.format(1)} stdout P lost", 1), ("g", 1, "no line", 1), ("g", 2, f"{t.format(1)} stdout F ", 1),
             ("h", 0, "2024-01-01T01:00:00Z stdout F beat", 2), ("h", 1, "2024-01-01T02:00:00Z stdout F beat", 3)]
    schema = "file string, line_no long, value string"
    frame = spark.createDataFrame([r[:-1] for r in lines], schema)

    def job(stream, root):
        return lambda out=ps.src_cri_logs(stream).select("file", "line_no", "stream", "raw"): sj.run_available_now(out, f"{root}/out", f"{root}/ck")

    root = slices(spark, lines, schema, 4, job)
    want = ps.src_cri_logs(frame).select("file", "line_no", "stream", "raw")
    got = spark.read.parquet(f"{root}/out")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.filter("raw = 'one two three'").count() == 1

    pieces = [("f", 0, "P", "stdout", 5 * S, "left", 0), ("g", 0, "F", "stdout", 90 * MIN, "x", 1), ("g", 1, "F", "stdout", 95 * MIN, "y", 2)]
    root = slices(spark, pieces, "file string, line_no long, tag string, stream string, time_us long, log string", 3,
                  lambda stream, root: lambda: sj.run_available_now(assembled_lines(stream), f"{root}/out", f"{root}/ck"))
    assert [(r.text, r.time_us) for r in spark.read.parquet(f"{root}/out").filter("not closed").collect()] == [("left", 5 * S)]


def test_topic_offsets(spark, tmp_path):
    path = str(tmp_path / "topic")
    first = spark.createDataFrame([(f"k{i % 7}", f'{{"n": {i}}}\n"é"') for i in range(100)] + [(None, None)], "key string, value string")
    tp.append_messages(first, path, 3)
    tp.append_messages(first.limit(10), path, 3)
    rows = tp.read_topic(spark, path).collect()
    assert len(rows) == 111 and sorted((r.key or "", r.value or "") for r in rows) == sorted((r.key or "", r.value or "") for r in first.unionByName(first.limit(10)).collect())
    for p in {r.partition for r in rows}:
        assert sorted(r.offset for r in rows if r.partition == p) == list(range(sum(r.partition == p for r in rows)))
    assert all(len({r.partition for r in rows if r.key == k}) == 1 for k in {r.key for r in rows})
    # A stream that fails between write and commit reads the same offsets again, then only new ones.
    stream, out, ck, seen = tp.read_topic(spark, path, streaming=True), str(tmp_path / "out"), str(tmp_path / "ck"), []
    write = sj.idempotent_batches(out, fail_once=0)

    def noted(batch, batch_id):
        seen.append((batch_id, batch.count()))
        write(batch, batch_id)

    with pytest.raises(StreamingQueryException):
        sj.run_foreach_batch(stream, noted, ck, mode="append")
    tp.append_messages(first.limit(5), path, 3)
    for _ in range(2):  # the batch that failed, then what came since
        sj.run_foreach_batch(stream, noted, ck, mode="append")
    assert seen[0] == seen[1] == (0, 111) and sum(n for _, n in seen[2:]) == 5
    assert spark.read.parquet(out).count() == 116 == spark.read.parquet(out).select("partition", "offset").distinct().count()
    assert ps.src_alert_events(spark, path).count() == 116
    assert tp.read_topic(spark, str(tmp_path / "nothing")).count() == 0


def test_versions_are_seen_whole(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, t long").schema
    table = VersionedTable(spark, str(tmp_path / "t"), schema)
    assert table.read().count() == 0 and table.before(None) is None
    table.replace(spark.createDataFrame([("a", 1)], schema), 0)
    reader = table.read()
    spark.createDataFrame([("b", 2)], schema).write.parquet(table._folder(1, "all"))  # written, not committed
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]
    table.replace(spark.createDataFrame([("c", 3)], schema), 1)
    assert [tuple(r) for r in table.read().collect()] == [("c", 3)] and [tuple(r) for r in reader.collect()] == [("a", 1)]
    table.replace(spark.createDataFrame([], schema), 2)
    assert table.read().count() == 0
    table.vacuum(keep=1)
    assert table.versions() == [2] and not glob.glob(str(tmp_path / "t/data/v0/*/*.parquet"))


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, t long, v string").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], ["t"], buckets=16)
    table.upsert(spark.createDataFrame([(f"k{i}", 5, "old") for i in range(50)], schema), 0)
    batch = spark.createDataFrame([("k7", 6, "new"), ("k7", 4, "older"), ("k9", 1, "late"), ("x", 1, "first")], schema)
    table.upsert(batch, 3)
    table.upsert(batch, 3)  # the batch once more
    rows = {r.k: r.v for r in table.read().collect()}
    assert len(rows) == 51 == table.read().count() and rows["k7"] == "new" and rows["k9"] == "old" and rows["x"] == "first"
    old, new = table.manifest(0), table.manifest(3)
    assert 1 <= sum(new[p] == 3 for p in new) <= 3 and all(new[p] in (0, 3) for p in new) and set(old) <= set(new)
    table.upsert(batch.limit(0), 4)
    assert table.manifest(4) == new and table.read().count() == 51


def test_dedupe_of_many_keys_in_a_group(spark):
    from vigil.operators.scans import greedy_ttl_accept

    rng = random.Random(5)
    schema = ", ".join(f"{c} {'long' if c.endswith('_us') or c == 'event_id' else 'string'}" for c in sj.ALERT_COLS)
    rows, start = [], 1000 * MIN
    for i in range(600):
        t = start + rng.randrange(90) * MIN + rng.choice([0, 0, rng.randrange(MIN)])
        late = rng.randrange(4 * MIN)
        status = rng.choice(["firing", "firing", "resolved"])
        ends = rng.choice([t, None]) if status == "resolved" else None
        rows.append((f"f{rng.randrange(15)}", i, status, "a", "h", None, start + rng.randrange(2) * MIN, ends, t, min(3, (t + late - start) // (24 * MIN))))
    rows.append((*rows[0][:2], "unknown", *rows[0][3:]))
    root = slices(spark, rows, schema, 4, lambda stream, root: lambda out=sj.dedupe_stream(stream, "5m", groups=3): sj.run_available_now(out, f"{root}/out", f"{root}/ck"))
    got = {(r.event_id, r.status): r.accepted for r in spark.read.parquet(f"{root}/out").collect()}
    # Plain: slice by slice, each key's events in order; what came in an earlier slice is known.
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[-1], r[8], r[1])):
        key = (r[0], r[2], r[6], r[7])
        want[r[1], r[2]] = r[2] != "unknown" and (key not in last or r[8] - last[key] > 5 * MIN)
        if want[r[1], r[2]]:
            last[key] = r[8]
    assert got == want and 0 < sum(got.values()) < 600
    st = spark.read.format("statestore").option("path", f"{root}/ck").option("stateVarName", "last").load()
    assert st.count() <= 3  # a value per group, not per key


def test_an_append_is_dealt_to_several_files(spark, tmp_path):
    path = str(tmp_path / "topic")
    msgs = spark.createDataFrame([("hot", f'{{"n": {i}}}\n"é ') for i in range(400)] + [(None, None)], "key string, value string")
    tp.append_messages(msgs, path, 2)
    files = tp.segments(path)
    assert max(len(f) for f in files.values()) > 1
    for found in files.values():  # gapless, file after file
        assert [f[0] for f in found] == [0, *(f[1] for f in found[:-1])]
    got = tp.read_topic(spark, path).select("key", "value").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, msgs.collect()))
