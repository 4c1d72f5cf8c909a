"""Alert routing rules: fingerprints, grouping, inhibition, resolve timeout (notification flushes: ``notify``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.labels import fingerprint as fp_col
from vigil.functions.labels import label_text
from vigil.functions.timeutil import dur_us
from vigil.operators.scans import DEFAULT_BUCKET_US, keyed_lag, keyed_running_sum

GROUP_BY = ("alertname", "instance")
RESOLVE_TIMEOUT = "5m"


def fingerprint(df: DataFrame, labels: str = "labels", out: str = "fingerprint") -> DataFrame:
    """md5 of the canonical ``k=v`` text of the label set (reproducible in any SQL engine)."""
    return df.withColumn(out, fp_col(labels))


def _group_cols(by: Sequence[str]):
    return [F.coalesce(F.element_at("labels", F.lit(k)), F.lit("")).alias(k) for k in by]


def alert_groups(A: DataFrame, by: Sequence[str] = GROUP_BY) -> DataFrame:
    """Notification groups: members, group status (firing if any member fires), and the
    common labels/annotations (entries every member carries with the same value)."""
    by = list(by)
    a = A.select(*_group_cols(by), "fingerprint", "status", "labels", "annotations")
    g = a.groupBy(*by).agg(
        F.array_sort(F.collect_set("fingerprint")).alias("members"),
        F.count(F.lit(1)).alias("n_members"),
        F.when(F.bool_or(F.col("status") == "firing"), "firing").otherwise("resolved").alias("status"))

    def common(col: str, out: str) -> DataFrame:
        e = a.select(*by, F.explode(col).alias("k", "v"))
        c = e.groupBy(*by, "k", "v").agg(F.count(F.lit(1)).alias("_n"))
        c = c.join(g.select(*by, "n_members"), by).filter(F.col("_n") == F.col("n_members"))
        return c.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(out))

    out = g.join(common("labels", "common_labels"), by, "left").join(common("annotations", "common_annotations"), by,
                                                                       "left")
    group_labels = F.create_map(*[x for k in by for x in (F.lit(k), F.col(k))])
    return out.withColumn("group_labels", group_labels)


SOURCE, TARGET = {"severity": "critical"}, {"severity": "warning"}


def _match(m: dict) -> Column:
    c = F.lit(True)
    for k, v in m.items():
        c = c & (F.element_at("labels", F.lit(k)) == v)
    return c


def alert_inhibit(A: DataFrame, source: dict | None = None, target: dict | None = None,
                  equal: Sequence[str] = GROUP_BY) -> DataFrame:
    """Drop target alerts (default ``severity=warning``) while a firing source alert
    (default ``severity=critical``) has equal values on ``equal`` (absent on both = equal)."""
    source, target, match = source or SOURCE, target or TARGET, _match
    eq = [F.coalesce(F.element_at("labels", F.lit(k)), F.lit("")).alias(f"_eq_{k}") for k in equal]
    src = A.filter(match(source) & (F.col("status") == "firing")).select(*eq).distinct()
    keyed = A.select("*", *eq)
    tgt = keyed.filter(match(target))
    rest = keyed.filter(~match(target) | match(target).isNull())
    keys = [f"_eq_{k}" for k in equal]
    kept = tgt.join(src, keys, "left_anti")
    return rest.unionByName(kept).drop(*keys)


def firing_intervals(E: DataFrame, now_us: int, bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """When each alert fired: ``fingerprint, event_id, labels, start_us, end_us`` (half open, up to ``now``).

    A change of status or labels ends an interval; ``event_id`` and ``labels`` are those of the event that opened it.
    """
    e = E.select("fingerprint", "event_id", "status", "labels", "received_us", label_text("labels").alias("_text")).filter(F.col("received_us") < now_us)
    e = keyed_lag(e, ["fingerprint"], "received_us", "event_id", ["status", "_text"], bucket_us)
    e = e.filter(F.col("prev_status").isNull() | (F.col("prev_status") != F.col("status")) | ~F.col("prev__text").eqNullSafe(F.col("_text")))
    e = e.select("fingerprint", "event_id", "status", "labels", "received_us", (-F.col("received_us")).alias("_neg"), (-F.col("event_id")).alias("_negid"))
    e = keyed_lag(e, ["fingerprint"], "_neg", "_negid", ["received_us"], bucket_us, prefix="next_")
    e = e.filter(F.col("status") == "firing").select("fingerprint", "event_id", "labels", F.col("received_us").alias("start_us"),
                                                     F.coalesce("next_received_us", F.lit(now_us)).alias("end_us"))
    return e.filter("start_us < end_us")


def _over_buckets(df: DataFrame, start: str, end: str, bucket_us: int, out: str) -> DataFrame:
    """A copy of each half-open interval for every bucket it touches."""
    return df.withColumn(out, F.explode(F.sequence(F.floor(F.col(start) / F.lit(bucket_us)), F.floor((F.col(end) - 1) / F.lit(bucket_us)))))


def alert_inhibit_intervals(E: DataFrame, now_us: int, source: dict | None = None, target: dict | None = None,
                            equal: Sequence[str] = GROUP_BY, bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """The times in which alerts are not inhibited: ``fingerprint, event_id, start_us, end_us``.

    Intervals of target alerts (default ``severity=warning``) lose every stretch in which a source
    alert (default ``severity=critical``) with equal values on ``equal`` fires; all others stay whole.

    Sources are added up along time (a keyed running sum), which leaves the disjoint stretches
    without any; targets meet those by (equal values, time bucket), each pair in one bucket only.
    """
    keys = [f"_eq_{k}" for k in equal]
    iv = firing_intervals(E, now_us, bucket_us).select("*", *(F.coalesce(F.element_at("labels", F.lit(k)), F.lit("")).alias(f"_eq_{k}") for k in equal))
    is_target = F.coalesce(_match(target or TARGET), F.lit(False))
    rest, hit = iv.filter(~is_target), iv.filter(is_target)
    src = iv.filter(_match(source or SOURCE))
    edges = src.select(*keys, F.col("start_us").alias("at"), F.lit(1).cast("bigint").alias("step")).unionByName(
        src.select(*keys, F.col("end_us").alias("at"), F.lit(-1).cast("bigint").alias("step")))
    edges = edges.groupBy(*keys, "at").agg(F.sum("step").alias("step")).withColumn("_tie", F.lit(0))
    edges = keyed_running_sum(edges, keys, "at", "_tie", "step", "on", bucket_us).withColumn("_neg", -F.col("at"))
    edges = keyed_lag(edges, keys, "_neg", "_tie", ["at"], bucket_us, prefix="next_")
    # Without a source: from each moment at which the last one ends, and before the first one of the key.
    lowest = hit.groupBy(*keys).agg(F.min("start_us").alias("lowest"))
    first = edges.groupBy(*keys).agg(F.min("at").alias("first"))
    before = lowest.join(first, keys, "left").select(*keys, F.col("lowest").alias("free_us"), F.coalesce("first", F.lit(now_us)).alias("until_us"))
    after = edges.filter("on = 0").select(*keys, F.col("at").alias("free_us"), F.coalesce("next_at", F.lit(now_us)).alias("until_us"))
    free = _over_buckets(before.unionByName(after).filter("free_us < until_us"), "free_us", "until_us", bucket_us, "_b")
    both = _over_buckets(hit, "start_us", "end_us", bucket_us, "_b").join(free, [*keys, "_b"])
    begin = F.greatest("start_us", "free_us")
    both = both.filter((F.floor(begin / F.lit(bucket_us)) == F.col("_b")) & (begin < F.least("end_us", "until_us")))
    pieces = both.select("fingerprint", "event_id", begin.alias("start_us"), F.least("end_us", "until_us").alias("end_us"))
    return rest.select("fingerprint", "event_id", "start_us", "end_us").unionByName(pieces)


def alert_resolve_timeout(E: DataFrame, now_us: int, timeout: str | int = RESOLVE_TIMEOUT) -> DataFrame:
    """Synthetic ``resolved`` events for firing alerts that received no update for
    ``timeout``: one per gap, at ``last_update + timeout`` (or while ``now`` is past it)."""
    to = dur_us(timeout)
    # next event per fingerprint = previous event in reversed time (skew-safe keyed scan)
    r = E.select("fingerprint", "event_id", "status", "labels", "annotations", "starts_us", "received_us",
                 (-F.col("received_us")).alias("_neg"), (-F.col("event_id")).alias("_negid"))
    r = keyed_lag(r, ["fingerprint"], "_neg", "_negid", ["received_us"], prefix="next_")
    gap_end = F.coalesce(F.col("next_received_us"), F.lit(now_us))
    stale = (F.col("status") == "firing") & (gap_end - F.col("received_us") > to)
    return r.filter(stale).select(
        "fingerprint", "event_id", F.lit("resolved").alias("status"), "labels", "annotations", "starts_us",
        (F.col("received_us") + F.lit(to)).alias("ends_us"), (F.col("received_us") + F.lit(to)).alias("received_us"))
