"""Sinks and retention: long-term sample copies, the alert-event topic, daily log
partitions, horizon-based retention and the hot/cold tiered read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.timeutil import dur_us
from vigil.sources.parsers import kafka_available, us_to_rfc3339

# Retention horizons (fixed values): logs 30 d, hot samples 6 h, cold samples 90 d.
RETENTION = {"logs": "30d", "hot_samples": "6h", "cold_samples": "90d"}
LOG_INDEX_PREFIX = "logs"


def with_day(df: DataFrame, ts_us: str = "t_us", out: str = "day") -> DataFrame:
    return df.withColumn(out, F.date_format(F.timestamp_micros(F.col(ts_us)), "yyyy-MM-dd"))


def log_daily_partition(L: DataFrame, prefix: str = LOG_INDEX_PREFIX, ts_us: str = "t_us") -> DataFrame:
    """Daily index name ``prefix-YYYY.MM.DD`` (UTC) and the ``day`` partition column."""
    d = F.timestamp_micros(F.col(ts_us))
    return (L.withColumn("index", F.concat(F.lit(prefix + "-"), F.date_format(d, "yyyy.MM.dd")))
            .withColumn("day", F.date_format(d, "yyyy-MM-dd")))


def write_log_partitions(L: DataFrame, path: str, mode: str = "append") -> None:
    """Write logs partitioned by day; expiry then drops whole partitions (no row deletes)."""
    log_daily_partition(L).write.mode(mode).partitionBy("day").parquet(path)


def sink_samples(S: DataFrame, path: str, checkpoint: str | None = None, mode: str = "append"):
    """Long-term copy of every sample, partitioned by (day, metric) so retention and
    metric selection prune directories. Streaming inputs get a checkpointed file sink."""
    out = with_day(S).select("day", "metric", "labels", "instance", "series", "t_us", "value")
    if S.isStreaming:
        if not checkpoint:
            raise ValueError("a streaming sink needs a checkpoint location")
        return (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                .partitionBy("day", "metric").outputMode("append"))
    out.write.mode(mode).partitionBy("day", "metric").parquet(path)
    return None


def alert_event_messages(E: DataFrame) -> DataFrame:
    """Deduplicated events as topic messages: key = fingerprint, value = JSON with
    ``type`` defaulting to ``alert`` and RFC3339 times."""
    t = F.coalesce(F.col("type"), F.lit("alert")) if "type" in E.columns else F.lit("alert")
    value = F.to_json(F.struct(
        t.alias("type"), F.col("fingerprint"), F.col("status"), F.col("labels"), F.col("annotations"),
        us_to_rfc3339(F.col("starts_us")).alias("startsAt"), us_to_rfc3339(F.col("ends_us")).alias("endsAt"),
        F.coalesce(F.col("generator_url"), F.lit("")).alias("generatorURL"),
        us_to_rfc3339(F.col("received_us")).alias("receivedAt")))
    return E.select(F.col("fingerprint").alias("key"), value.alias("value"))


def sink_alert_events(E: DataFrame, path: str | None = None, kafka: dict | None = None,
                      topic: str = "alert-events", checkpoint: str | None = None):
    """Publish messages keyed by fingerprint (the topic hash-partitions by key): Kafka when
    the connector is present, else JSON-lines files."""
    msgs = alert_event_messages(E)
    spark = E.sparkSession
    if kafka and kafka_available(spark):
        w = msgs.writeStream if E.isStreaming else msgs.write
        w = w.format("kafka").options(topic=topic, **kafka)
        if E.isStreaming:
            return w.option("checkpointLocation", checkpoint)
        w.save()
        return None
    if path is None:
        raise ValueError("need a path (or kafka options with the connector present)")
    if E.isStreaming:
        return (msgs.select("value").writeStream.format("text").option("path", path)
                .option("checkpointLocation", checkpoint))
    msgs.select("value").write.mode("append").text(path)
    return None


def retention(df: DataFrame, horizon: str | int, now_us: int, ts_us: str = "t_us") -> DataFrame:
    """Keep rows newer than ``now - horizon`` (a partition filter when ``df`` is partitioned
    by day: whole expired partitions are pruned, never read)."""
    cutoff = now_us - dur_us(horizon)
    out = df.filter(F.col(ts_us) >= cutoff)
    if "day" in df.columns:
        day = F.date_format(F.timestamp_micros(F.lit(cutoff)), "yyyy-MM-dd")
        out = out.filter(F.col("day") >= day)
    return out


def tiered_read(hot: DataFrame, cold: DataFrame, ts_us: str = "t_us") -> DataFrame:
    """Recent range from the hot table, older rows from the cold copy, no double counting:
    cold rows are taken only before the hot table's first timestamp (a scalar subquery)."""
    first_hot = hot.select(F.min(ts_us)).scalar()
    cols = hot.columns
    return hot.unionByName(cold.select(*cols).filter(F.col(ts_us) < F.coalesce(first_hot, F.lit(2**62))))
