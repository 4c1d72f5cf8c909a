"""Structured Streaming twins of the batch operators.

Keyed state lives in ``transformWithStateInPandas`` processors (RocksDB state store). State is
one value per key, or the times inside one window, and an event-time timer clears it once the
watermark shows that it can no longer matter, so keys that fall silent cost nothing. Keys are as
fine as the rule allows (de-duplication: fingerprint, status and times), so a hot fingerprint
spreads. Sinks are checkpointed file sinks or idempotent ``foreachBatch`` writers keyed by batch
id, so a restarted query (or a lost executor) never duplicates output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.functions.labels import trim_space
from vigil.functions.timeutil import dur_us
from vigil.session import checkpoint_dir
from vigil.streaming.tables import KeyedTable, VersionedTable, newest_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enable_state_store(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Replay:
    """A table as a growing file stream: its rows arrive in ``parts`` slices of ``ts``.

    One pass writes the rows by slice, all tasks at once; ``each`` then appends slice after slice
    to the folder of ``stream`` and runs the query to its end, so the query is stopped and
    started again from its checkpoint between slices.
    """

    def __init__(self, spark: SparkSession, df: DataFrame, ts: str, name: str, parts: int = 4):
        enable_state_store(spark)
        self.spark, self.parts, self.root = spark, parts, scratch(spark, name)
        b = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
        lo, hi = int(b["lo"] or 0), int(b["hi"] or 0) + 1
        at = F.least(F.floor((F.col(ts) - F.lit(lo)) * F.lit(parts) / F.lit(hi - lo)), F.lit(parts - 1)).cast("int")
        df.withColumn("_slice", at).write.partitionBy("_slice").parquet(f"{self.root}/staged")
        self.schema = df.schema
        spark.createDataFrame([], self.schema).write.parquet(f"{self.root}/in")
        self.stream = file_stream(spark, f"{self.root}/in", self.schema, None)

    def each(self, run: Callable[[], None]) -> None:
        staged = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(f"{self.root}/staged")
        for i in range(self.parts):
            staged.filter(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(f"{self.root}/in")
            run()

    def beat(self, run: Callable[[], None], *rows: dict) -> None:
        """One more slice a row: heartbeats, whose other columns are null."""
        for row in rows:
            values = [tuple(row.get(f.name) for f in self.schema.fields)]
            self.spark.createDataFrame(values, T.StructType([T.StructField(f.name, f.dataType) for f in self.schema.fields])).write.mode("append").parquet(f"{self.root}/in")
            run()


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = 1,
                glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def run_available_now(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                      partition_by: list[str] | None = None) -> None:
    """Checkpointed parquet sink, run until the input is drained."""
    w = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()


def idempotent_batches(path: str, fail_once: int | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: each micro-batch overwrites ``path/batch_id=<id>``, so a replay
    of a batch after a failure replaces its output instead of adding to it. With
    ``fail_once`` the query fails after writing that batch, the first time."""
    failures = {fail_once}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if batch_id in failures:
            failures.discard(batch_id)
            raise RuntimeError("the sink fails after its write, once")

    return write


def run_periodic(df: DataFrame, fn, checkpoint: str, every: str = "5 seconds", mode: str = "complete") -> None:
    """``foreachBatch`` at a processing-time trigger, stopped once the input so far is worked off."""
    q = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode).trigger(processingTime=every).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def run_foreach_batch(df: DataFrame, fn, checkpoint: str, mode: str = "update") -> None:
    (df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode)
     .trigger(availableNow=True).start().awaitTermination())


# ---------------------------------------------------------------- alert events: dedupe + active set

WATERMARK = "10 minutes"


def _timed(df: DataFrame, t_us: str, delay: str = WATERMARK) -> DataFrame:
    """``df`` with an event-time column and a watermark."""
    return df.withColumn("ts", F.timestamp_micros(t_us)).withWatermark("ts", delay)


def _sorted(rows, *cols: str) -> list[np.ndarray]:
    """The named number columns of a key's rows of one micro-batch, ordered by them."""
    kept = [np.stack([c[x].to_numpy(np.int64) for x in cols]) for c in rows]
    both = np.concatenate(kept, 1)
    return list(both[:, np.lexsort(both[::-1])])


class _Clearing(StatefulProcessor):
    """A processor whose state is dropped by an event-time timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def expire_at(self, t_us: int) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(t_us // 1000 + 1)

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.forget()
        yield from ()

    def close(self) -> None:
        pass


ALERT_COLS = ["fingerprint", "event_id", "status", "alertname", "instance", "severity", "starts_us", "ends_us", "received_us"]
SEEN_OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("accepted", T.BooleanType()),
                         *(T.StructField(c, T.LongType() if c.endswith("_us") else T.StringType()) for c in ALERT_COLS if c != "event_id")])


DEDUPE_KEY = ["fingerprint", "status", "starts_us", "ends_us"]
#: Groups that the keys of de-duplication are dealt into: state and timers cost per group, not per key.
DEDUPE_GROUPS = 512
SEEN_STATE = "fingerprint array<string>, status array<string>, starts_us array<long>, ends_us array<long>, last_us array<long>"


class DedupeProcessor(_Clearing):
    """Per (fingerprint, status, starts, ends): a repeat within ``ttl`` of the accepted event is
    dropped and does not extend the window. A group holds many such keys; its state is the time of
    the last accepted event of those whose window the watermark has not passed."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", SEEN_STATE)

    def forget(self) -> None:
        self.last.clear()

    def handleInputRows(self, key, rows, timerValues):
        chunks = list(rows)
        old = pd.DataFrame(dict(zip([*DEDUPE_KEY, "last_us"], self.last.get())) if self.last.exists() else {c: [] for c in [*DEDUPE_KEY, "last_us"]}, dtype=object)
        keys = pd.concat([old[DEDUPE_KEY], *(c[DEDUPE_KEY].astype(object) for c in chunks)], ignore_index=True)
        keys["ends_us"] = keys["ends_us"].where(keys["ends_us"].notna(), -1)
        code = keys.groupby(DEDUPE_KEY, sort=False, dropna=False).ngroup().to_numpy()
        last = dict(zip(code.tolist(), old["last_us"].tolist()))
        code = code[len(old):]
        first = np.unique(code, return_index=True)[1] + len(old)  # a row of each key of this batch
        t, i = (np.concatenate([c[x].to_numpy(np.int64) for c in chunks]) for x in ("received_us", "event_id"))
        known = np.concatenate([c["status"].isin(["firing", "resolved"]).to_numpy(bool) for c in chunks])
        order = np.lexsort((i, t, code))
        order = order[known[order]]
        accepted = np.zeros(len(code), bool)
        for row, k, at in zip(order.tolist(), code[order].tolist(), t[order].tolist()):
            if k not in last or at - last[k] > self.ttl_us:
                last[k] = at
                accepted[row] = True
        if len(np.unique(i)) < len(i):  # an id that comes twice in a key is accepted or not as one
            accepted = pd.Series(accepted).groupby([code, i]).transform("any").to_numpy()
        self._keep(keys, first, code, old, last, timerValues.getCurrentWatermarkInMs() * 1000)
        ends = np.cumsum([len(c) for c in chunks])
        for c, z in zip(chunks, ends.tolist()):
            yield c[["event_id"]].assign(accepted=accepted[z - len(c):z], **{x: c[x] for x in ALERT_COLS if x != "event_id"})

    def _keep(self, keys, first, code, old, last, watermark_us) -> None:
        """Store the keys whose window is open; the timer clears them all when the last one has closed."""
        rows = dict(zip(code[first - len(old)].tolist(), first.tolist()))
        rows = {**dict(zip(list(last)[:len(old)], range(len(old)))), **rows}
        kept = [k for k in last if last[k] + self.ttl_us >= watermark_us]
        if kept:
            of = keys.iloc[[rows[k] for k in kept]]
            plain = [[None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in of[c]] for c in DEDUPE_KEY]
            self.last.update((*plain, [last[k] for k in kept]))
            self.expire_at(max(last[k] for k in kept) + self.ttl_us)
        elif self.last.exists():
            self.last.clear()


def dedupe_stream(E: DataFrame, ttl: str | int = "5m", groups: int = DEDUPE_GROUPS) -> DataFrame:
    """Streaming de-duplication: all events with ``accepted``."""
    group = F.pmod(F.xxhash64(*DEDUPE_KEY[:3], F.coalesce("ends_us", F.lit(-1))), F.lit(groups))
    e = E.select(*ALERT_COLS).withColumn("_group", group)
    return _timed(e, "received_us").groupBy("_group").transformWithStateInPandas(
        DedupeProcessor(dur_us(ttl)), SEEN_OUT, "Append", "EventTime")


EDGE_OUT = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("edge", T.StringType())])
ACTIVE_STATE = "event_id long, status string, alertname string, instance string, severity string, starts_us long, received_us long"


class ActiveProcessor(StatefulProcessor):
    """Per fingerprint: the active record. An accepted firing event sets it (edge ``added`` or
    ``updated``), a resolved one removes it (edge ``removed``)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", ACTIVE_STATE)

    def handleInputRows(self, key, rows, timerValues):
        # Edges need each event's time and whether it fires; of the rows themselves only the newest is kept.
        parts, newest = [], None
        for c in rows:
            t, i = c["received_us"].to_numpy(np.int64), c["event_id"].to_numpy(np.int64)
            parts.append((t, i, (c["status"] == "firing").to_numpy()))
            last = c.iloc[int(np.lexsort((i, t))[-1])]
            if newest is None or (last.received_us, last.event_id) > (newest.received_us, newest.event_id):
                newest = last
        t, i, firing = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((i, t))
        i, firing = i[order], firing[order]
        on = np.concatenate([[self.active.exists()], firing[:-1]])
        edge = np.where(firing, np.where(on, "updated", "added"), np.where(on, "removed", None))
        if newest.status == "firing":
            self.active.update((int(newest.event_id), newest.status, newest.alertname, newest.instance, newest.severity, int(newest.starts_us),
                                int(newest.received_us)))
        elif self.active.exists():
            self.active.clear()
        yield pd.DataFrame({"fingerprint": key[0], "event_id": i, "edge": edge})

    def close(self) -> None:
        pass


def active_stream(accepted: DataFrame) -> DataFrame:
    """Edges of the active set; the set itself is the state (see ``active_state``)."""
    return accepted.filter("accepted").groupBy("fingerprint").transformWithStateInPandas(ActiveProcessor(), EDGE_OUT, "Append", "None")


ACTIVE_COLS = ["fingerprint", "status", "alertname", "instance", "severity", "starts_us", "received_us", "event_id"]
_LONGS = ("event_id", "starts_us", "received_us")
ACTIVE_TABLE = T.StructType([T.StructField(c, T.LongType() if c in _LONGS else T.StringType()) for c in ACTIVE_COLS])
RING_TABLE = T.StructType([T.StructField(c, T.LongType() if c in _LONGS else T.StringType()) for c in ("event_id", "fingerprint", "status", "severity", "received_us")])


def active_table(spark: SparkSession, root: str) -> KeyedTable:
    """The newest accepted event per fingerprint; those that fire are the active set (the rest say that an older event is over)."""
    return KeyedTable(spark, root, ACTIVE_TABLE, ["fingerprint"], ["received_us", "event_id"])


def ring_table(spark: SparkSession, root: str) -> VersionedTable:
    return VersionedTable(spark, root, RING_TABLE)


def maintain_active(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: accepted events into the active table."""
    return lambda batch, batch_id: table.upsert(batch.filter("accepted"), batch_id)


def maintain_ring(table: VersionedTable, n: int = 200) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: the newest ``n`` accepted events."""
    return lambda batch, batch_id: newest_rows(table, batch.filter("accepted"), batch_id, n, "received_us", "event_id")


def active_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The running active set, read from the state of ``active_stream``."""
    st = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "active").load()
    return st.select("key.fingerprint", "value.*")


def stats_stream(accepted: DataFrame) -> DataFrame:
    """Running firing counts by alertname (fingerprint when blank): streaming aggregate."""
    key = F.coalesce(F.nullif(trim_space("alertname"), F.lit("")), F.col("fingerprint"))
    return (accepted.filter(F.col("accepted") & (F.col("status") == "firing"))
            .groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- per-event sliding window (rate limit)

LIMIT_OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("used", T.LongType())])


class SlidingCountProcessor(_Clearing):
    """Per (ip, route): timestamps of the last ``window`` (closed at both ends); each request
    counts everything still inside, itself included, rejected ones too."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "t_us long")

    def forget(self) -> None:
        self.recent.clear()

    def handleInputRows(self, key, rows, timerValues):
        times, ids = _sorted(rows, "t_us", "event_id")
        old = np.array([x[0] for x in self.recent.get()] if self.recent.exists() else [], np.int64)
        both = np.concatenate([old, times])  # what is kept is older than the new rows
        at = np.arange(len(old), len(both))
        used = at - np.searchsorted(both, times - self.window_us, side="left") + 1
        self.recent.put([(int(x),) for x in both[both >= both[-1] - self.window_us]])
        self.expire_at(int(both[-1]) + self.window_us)
        yield pd.DataFrame({"event_id": ids, "used": used})


def sliding_limit_stream(R: DataFrame, limit: int = 120, window: str | int = "60s") -> DataFrame:
    from vigil.operators.logs import RATE_PREFIXES, RATE_SKIP, route_template
    r = R.filter(~F.col("route").isin(*RATE_SKIP)
                 & (F.col("route").startswith(RATE_PREFIXES[0]) | F.col("route").startswith(RATE_PREFIXES[1])))
    r = r.select("client_ip", route_template(F.col("route")).alias("route"), "t_us", "event_id")
    out = _timed(r, "t_us").groupBy("client_ip", "route").transformWithStateInPandas(
        SlidingCountProcessor(dur_us(window)), LIMIT_OUT, "Append", "EventTime")
    return (out.withColumn("allowed", F.col("used") <= limit)
            .withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).cast("bigint")))


# ---------------------------------------------------------------- tumbling counts, snapshots, bad records

def tumbling_stream(L: DataFrame, window: str = "5 minutes", watermark: str = WATERMARK,
                    by: tuple[str, ...] = ("level",)) -> DataFrame:
    """Event/log counts per interval with a watermark bounding the window state."""
    ts = F.timestamp_micros("t_us")
    return (L.withColumn("ts", ts).withWatermark("ts", watermark)
            .groupBy(F.window("ts", window), *by).agg(F.count(F.lit(1)).alias("n"))
            .select(F.unix_micros("window.start").alias("bucket_us"), *by, "n"))


def latest_per_series_stream(S: DataFrame) -> DataFrame:
    """Newest (value, t) per (instance, metric): the state behind the periodic host snapshot."""
    s = S.filter(F.col("metric").isin("cpu_usage_percent", "memory_usage_percent")
                 | ((F.col("metric") == "up") & (F.element_at("labels", F.lit("job")) == "probe")))
    return s.groupBy("instance", "metric").agg(
        F.max_by(F.struct("value", "t_us"), F.struct("t_us", "event_id")).alias("_m")).select(
        "instance", "metric", F.col("_m.value").alias("value"), F.col("_m.t_us").alias("t_us"))


def snapshot_from_latest(latest: DataFrame, now_us: int, lookback: str | int = "5m") -> DataFrame:
    """Host snapshot from the latest-per-series table (same rules as ``host_snapshot``)."""
    from vigil.operators.hosts import host_snapshot
    s = latest.select("metric", "instance", F.create_map(F.lit("job"), F.lit("probe")).alias("labels"), "t_us",
                      "value")
    return host_snapshot(s, now_us, lookback)


def split_bad_records(batch: DataFrame, good_path: str, bad_path: str, batch_id: int) -> None:
    """foreachBatch body: processed messages to the table, everything else to quarantine;
    both overwrite their batch partition (idempotent on replay)."""
    batch.persist()
    batch.filter(F.col("outcome") == "processed").write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
    batch.filter(F.col("outcome") != "processed").write.mode("overwrite").parquet(f"{bad_path}/batch_id={batch_id}")
    batch.unpersist()
