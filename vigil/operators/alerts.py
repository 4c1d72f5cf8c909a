"""Alert event processing: validation, TTL de-duplication, active set, recent list, stats,
history upsert and paging.

Alert events: ``event_id, fingerprint, status, labels MAP, annotations MAP, starts_us,
ends_us (NULL = zero time), generator_url, received_us`` (plus optional promoted
``alertname/instance/severity`` columns). Event order is ``(received_us, event_id)``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.labels import trim_space
from vigil.functions.timeutil import dur_us
from vigil.operators.scans import exact_percentiles, greedy_ttl_accept
from vigil.session import checkpoint_dir

STATUSES = ("firing", "resolved")
RECENT_DEFAULT = 8
RECENT_MAX = 200
RING_SIZE = 200
PAGE_DEFAULT = 20
PAGE_MAX = 100
WEB_DEDUPE_TTL = "24h"
SERVICE_DEDUPE_TTL = "5m"


def _lab(key: str) -> Column:
    return F.element_at("labels", F.lit(key))


def _order() -> Column:
    return F.struct(F.col("received_us"), F.col("event_id"))


def alert_validate(E: DataFrame) -> DataFrame:
    """outcome ``ok`` or ``permanent_error`` with the first failing reason."""
    fp_blank = F.coalesce("fingerprint", F.lit("")) == ""
    bad_status = ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    reason = (F.when(fp_blank, F.lit("fingerprint is required"))
              .when(bad_status, F.concat(F.lit("unsupported status: "), F.coalesce("status", F.lit("")))))
    return (E.withColumn("reason", reason)
            .withColumn("outcome", F.when(F.col("reason").isNull(), "ok").otherwise("permanent_error")))


def alert_dedupe_ttl(E: DataFrame, ttl: str | int = SERVICE_DEDUPE_TTL) -> DataFrame:
    """``accepted`` per event: the first event of a (fingerprint, status, starts, ends) key
    opens a TTL window; repeats within it (``<= ttl`` later) are dropped and do not extend
    it; the first one after it is accepted and opens the next window."""
    return greedy_ttl_accept(E, ["fingerprint", "status", "starts_us", "ends_us"], "received_us", "event_id",
                             dur_us(ttl))


def alert_active(E: DataFrame, dedupe_first: bool = True, ttl: str | int = SERVICE_DEDUPE_TTL) -> DataFrame:
    """Current active set: the newest event per fingerprint wins; keep it when firing.

    ``dedupe_first=True`` is the consumer rule (only accepted events touch the set);
    ``False`` is the web rule (every valid event upserts/removes before de-duplication).
    One partial aggregation by fingerprint: a hot fingerprint is combined map-side.
    """
    v = alert_validate(E).filter(F.col("outcome") == "ok").drop("outcome", "reason")
    if dedupe_first:
        v = alert_dedupe_ttl(v, ttl).filter("accepted").drop("accepted")
    cols = [c for c in v.columns if c != "fingerprint"]
    last = v.groupBy("fingerprint").agg(F.max_by(F.struct(*cols), _order()).alias("_e"))
    return last.select("fingerprint", "_e.*").filter(F.col("status") == "firing")


def alert_active_list(active: DataFrame, severity: str | None = None) -> DataFrame:
    """Filter by severity label (alerts without it never match); newest start first."""
    a = active
    if severity:
        a = a.filter(_lab("severity") == severity)
    return a.orderBy(F.col("starts_us").desc(), F.col("fingerprint"))


def _limit(n) -> int:
    try:
        n = int(n)
    except (TypeError, ValueError):
        return RECENT_DEFAULT
    if n <= 0:
        return RECENT_DEFAULT
    return min(n, RECENT_MAX)


def alert_recent(E: DataFrame, n=RECENT_DEFAULT, status: str | None = None, severity: str | None = None) -> DataFrame:
    """Newest ``n`` events (default 8, max 200) THEN status/severity filter, so fewer than
    ``n`` may come back. Top-k, no global sort."""
    top = E.orderBy(F.col("received_us").desc(), F.col("event_id").desc()).limit(_limit(n))
    if status:
        top = top.filter(F.col("status") == status)
    if severity:
        top = top.filter(_lab("severity") == severity)
    return top


def alert_ring(E: DataFrame, n: int = RING_SIZE) -> DataFrame:
    """The bounded event log: only the newest ``n`` events are kept."""
    return E.orderBy(F.col("received_us").desc(), F.col("event_id").desc()).limit(n)


def stats_key() -> Column:
    return F.coalesce(F.nullif(trim_space(_lab("alertname")), F.lit("")), F.col("fingerprint"))


def alert_stats(E: DataFrame, ttl: str | int = SERVICE_DEDUPE_TTL) -> DataFrame:
    """Cumulative accepted firing events by alertname (fingerprint when it is blank)."""
    v = alert_validate(E).filter(F.col("outcome") == "ok")
    acc = alert_dedupe_ttl(v.drop("outcome", "reason"), ttl).filter("accepted")
    return (acc.filter(F.col("status") == "firing").groupBy(stats_key().alias("key"))
            .agg(F.count(F.lit(1)).alias("n")))


def aggregate_key() -> Column:
    """``alertname:instance``, else ``alertname``, else the fingerprint."""
    name = trim_space(F.coalesce(_lab("alertname"), F.lit("")))
    inst = trim_space(F.coalesce(_lab("instance"), F.lit("")))
    return (F.when((name != "") & (inst != ""), F.concat(name, F.lit(":"), inst))
            .when(name != "", name).otherwise(F.col("fingerprint")))


def alert_aggregate_key(E: DataFrame) -> DataFrame:
    return E.groupBy(aggregate_key().alias("key")).agg(F.count(F.lit(1)).alias("n"))


def labels_json(labels: Column | str) -> Column:
    """Labels as JSON with sorted keys; ``{}`` for a null map."""
    m = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), F.lit("{}"))


def alert_history_build(E: DataFrame) -> DataFrame:
    """Event -> history row (trimmed fields, severity default ``warning``)."""
    sev = trim_space(F.coalesce(_lab("severity"), F.lit("")))
    return E.select(
        "event_id", "fingerprint",
        trim_space(F.coalesce(_lab("alertname"), F.lit(""))).alias("alert_name"),
        trim_space(F.coalesce(_lab("instance"), F.lit(""))).alias("instance"),
        F.when(sev == "", "warning").otherwise(sev).alias("severity"),
        "status",
        trim_space(F.coalesce(F.element_at("annotations", F.lit("summary")), F.lit(""))).alias("summary"),
        labels_json("labels").alias("labels_json"),
        F.col("starts_us").alias("fired_us"),
        F.when(F.col("status") == "resolved", F.col("ends_us")).alias("resolved_us"),
        "received_us",
    )


HISTORY_COLS = ["id", "fingerprint", "alert_name", "instance", "severity", "status", "summary", "labels_json",
                "fired_us", "resolved_us", "created_us"]


def alert_history_upsert(E: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Fold events into history rows keyed by (fingerprint, fired_at).

    Attributes come from the newest event; status only ever moves to ``resolved``;
    resolved_at is the end time of the newest resolved event; id/created_at come from
    the first event. An existing table is merged by a full outer join (the result is
    written back with overwrite — built-in file tables have no MERGE).
    """
    h = alert_history_build(E)
    o = _order()
    attrs = F.struct("alert_name", "instance", "severity", "summary", "labels_json")
    g = h.groupBy("fingerprint", "fired_us").agg(
        F.min_by("event_id", o).alias("id"),
        F.max_by(attrs, o).alias("_a"),
        F.min_by("status", o).alias("_first_status"),
        F.bool_or(F.col("status") == "resolved").alias("_res"),
        F.max_by(F.when(F.col("status") == "resolved", F.struct(F.col("resolved_us").alias("r"))),
                 F.when(F.col("status") == "resolved", o)).alias("_r"),
        F.min("received_us").alias("created_us"),
    )
    new = g.select(
        "id", "fingerprint", "_a.*",
        F.when(F.col("_res"), "resolved").otherwise(F.col("_first_status")).alias("status"),
        "fired_us", F.col("_r.r").alias("resolved_us"), "created_us",
    ).select(*HISTORY_COLS)
    if existing is None:
        return new
    ex = existing.select(*HISTORY_COLS).alias("x")
    nw = new.alias("n")
    j = ex.join(nw, (F.col("x.fingerprint") == F.col("n.fingerprint")) & (F.col("x.fired_us") == F.col("n.fired_us")),
                "full_outer")

    def pick(c):
        return F.coalesce(F.col(f"n.{c}"), F.col(f"x.{c}")).alias(c)

    status = (F.when((F.col("x.status") == "resolved") | (F.col("n.status") == "resolved"), "resolved")
              .otherwise(F.coalesce(F.col("x.status"), F.col("n.status"))))
    return j.select(
        F.coalesce("x.id", "n.id").alias("id"), pick("fingerprint"), pick("alert_name"), pick("instance"),
        pick("severity"), status.alias("status"), pick("summary"), pick("labels_json"), pick("fired_us"),
        pick("resolved_us"), F.coalesce("x.created_us", "n.created_us").alias("created_us"))


def alert_history_page(history: DataFrame, members: DataFrame | None = None, *, status: str | None = None,
                       severity: str | None = None, alert_name: str | None = None, instance: str | None = None,
                       fired_from_us: int | None = None, fired_to_us: int | None = None,
                       group_id: int | None = None, page: int = 1, page_size: int = PAGE_DEFAULT) -> DataFrame:
    """Filtered history, newest fired first (id desc on ties), one page plus ``total``.

    The page is a top-k with offset (never a global sort); ``total`` is a scalar
    subquery over the filtered rows.
    """
    page = page if isinstance(page, int) and page > 0 else 1
    if not isinstance(page_size, int) or page_size <= 0:
        page_size = PAGE_DEFAULT
    page_size = min(page_size, PAGE_MAX)
    h = history
    for col, v in (("status", status), ("severity", severity), ("alert_name", alert_name), ("instance", instance)):
        if v:
            h = h.filter(F.col(col) == v)
    if fired_from_us is not None:
        h = h.filter(F.col("fired_us") >= fired_from_us)
    if fired_to_us is not None:
        h = h.filter(F.col("fired_us") <= fired_to_us)
    if group_id is not None and members is not None:
        h = h.join(members.filter(F.col("group_id") == group_id).select("instance"), "instance", "left_semi")
    total = h.select(F.count(F.lit(1))).scalar()
    pg = (h.orderBy(F.col("fired_us").desc(), F.col("id").desc())
          .offset((page - 1) * page_size).limit(page_size))
    return pg.withColumn("total", total)


def alert_history_upsert_days(E: DataFrame, path: str) -> list[str]:
    """Fold events into a stored history that is partitioned by the day of ``fired_us``; the days that were rewritten.

    Only the days that the events name are read, merged and replaced (dynamic partition
    overwrite); files of other days are left alone. The merged days are stored in the shared
    folder before they replace the old ones, and folding the same events again changes nothing, so
    an upsert that failed half-way is simply run again.
    """
    spark = E.sparkSession


    def day(c: str) -> Column:
        return F.coalesce(F.date_format(F.timestamp_micros(c), "yyyy-MM-dd"), F.lit("none"))

    days = sorted(r.day for r in E.select(day("starts_us").alias("day")).distinct().collect())  # a number of days, not of rows
    if not days:
        return []
    try:
        known = spark.read.parquet(path)
    except AnalysisException as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    existing = None if known is None else known.filter(F.col("day").cast("string").isin(*days))
    merged = alert_history_upsert(E, existing).withColumn("day", day("fired_us"))
    staged = f"{checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    spark.read.schema(merged.schema).parquet(staged).repartition("day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return days


def alert_history_index(history: DataFrame, path: str, parts: int = 64) -> None:
    """Store a (filtered) history in page order, newest fired first, as ``parts`` ranges, with the rank at which each begins."""
    spark = history.sparkSession
    order = [F.col("fired_us").desc(), F.col("id").desc()]
    ranged = history.select(*HISTORY_COLS).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    rows = spark.read.schema(ranged.schema).parquet(f"{path}/rows")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")  # a row per range


def alert_history_page_at(spark: SparkSession, path: str, page: int = 1, page_size: int = PAGE_DEFAULT) -> DataFrame:
    """A page of a stored index, with ``total``: only the one or two ranges that hold it are read, however deep it is."""
    page = page if isinstance(page, int) and page > 0 else 1
    page_size = min(page_size if isinstance(page_size, int) and page_size > 0 else PAGE_DEFAULT, PAGE_MAX)
    low, high = (page - 1) * page_size, page * page_size
    index = spark.read.parquet(f"{path}/index").collect()  # as many rows as the index has ranges
    hold = [r for r in index if r.before < high and r.before + r.n > low]
    schema = T.StructType([*(T.StructField(c, T.LongType() if c == "id" or c.endswith("_us") else T.StringType()) for c in HISTORY_COLS), T.StructField("part", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows").filter(F.col("part").isin([r.part for r in hold]))
    begins = F.coalesce(*(F.when(F.col("part") == r.part, F.lit(r.before)) for r in hold), F.lit(0))
    rank = begins + F.row_number().over(Window.partitionBy("part").orderBy(F.col("fired_us").desc(), F.col("id").desc()))
    total = sum(r.n for r in index)
    return rows.withColumn("_rank", rank).filter((F.col("_rank") > low) & (F.col("_rank") <= high)).drop("_rank", "part").withColumn("total", F.lit(total).cast("bigint"))


def alert_severity_counts(active: DataFrame) -> DataFrame:
    """Dashboard counts by severity; a missing severity counts as ``info``."""
    return (active.groupBy(F.coalesce(_lab("severity"), F.lit("info")).alias("severity"))
            .agg(F.count(F.lit(1)).alias("n")))


def alert_outcomes(E: DataFrame, ttl: str | int = SERVICE_DEDUPE_TTL) -> DataFrame:
    """Per-event outcome (stored / deduped / failed) by status (firing / resolved / unknown)."""
    v = alert_validate(E)
    ok = alert_dedupe_ttl(v.filter(F.col("outcome") == "ok"), ttl)
    bad = v.filter(F.col("outcome") != "ok").withColumn("accepted", F.lit(None).cast("boolean"))
    u = ok.unionByName(bad)
    result = F.when(F.col("outcome") != "ok", "failed").when(F.col("accepted"), "stored").otherwise("deduped")
    st = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("unknown")
    return u.groupBy(result.alias("result"), st.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def alert_duration(history: DataFrame) -> DataFrame:
    """Seconds from fired to resolved per alert name: count, mean, median (exact), max."""
    d = history.filter(F.col("resolved_us").isNotNull()).select("alert_name", (F.col("resolved_us") - F.col("fired_us")).alias("_us"))
    r = exact_percentiles(d, ["alert_name"], "_us", {"median": 0.5}, width=60_000_000)
    return r.select("alert_name", "n", *((F.col(c) / 1e6).alias(f"{c}_s") for c in ("mean", "median", "max")))
