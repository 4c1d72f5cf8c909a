"""Host snapshots, filters, rankings, fleet overview and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.labels import trim_space
from vigil.functions.timeutil import SEC, dur_us

CPU = "cpu_usage_percent"
MEMORY = "memory_usage_percent"
UP = "up"
UP_JOB = "probe"


def host_snapshot(S: DataFrame, at_us: int, lookback: str | int = "5m", up_job: str = UP_JOB) -> DataFrame:
    """Merge of ``up``, cpu and memory by instance at ``at``, in ONE aggregation (no joins).

    status: ``up`` if up >= 1, ``down`` if up < 1, ``unknown`` without an up sample; missing
    cpu/memory are 0.0; last_scrape = newest of the three samples, truncated to seconds.
    """
    lb = dur_us(lookback)
    tie = "event_id" if "event_id" in S.columns else "value"
    is_up = (F.col("metric") == UP) & (F.element_at("labels", F.lit("job")) == up_job)
    s = S.filter((F.col("t_us") >= at_us - lb) & (F.col("t_us") <= at_us)
                 & (F.col("metric").isin(CPU, MEMORY) | (F.col("metric") == UP)))
    s = s.filter(F.col("metric").isin(CPU, MEMORY) | is_up)
    o = F.struct("t_us", tie)

    def newest(m):
        return F.max_by(F.when(F.col("metric") == m, F.struct("value", "t_us")), F.when(F.col("metric") == m, o))

    h = s.groupBy("instance").agg(newest(UP).alias("_u"), newest(CPU).alias("_c"), newest(MEMORY).alias("_m"))
    status = F.when(F.col("_u").isNull(), "unknown").when(F.col("_u.value") >= 1, "up").otherwise("down")
    last = F.greatest(F.col("_u.t_us"), F.col("_c.t_us"), F.col("_m.t_us"))
    return h.select(
        "instance",
        F.coalesce(F.col("_c.value"), F.lit(0.0)).alias("cpu"),
        F.coalesce(F.col("_m.value"), F.lit(0.0)).alias("memory"),
        status.alias("status"),
        (last - F.pmod(last, F.lit(SEC))).alias("last_scrape_us"),
    )


def host_filter_status(H: DataFrame, status: str | None) -> DataFrame:
    """``up`` keeps up hosts; ``down`` keeps every host that is not up (unknown included)."""
    if not status:
        return H
    if status == "up":
        return H.filter(F.col("status") == "up")
    if status == "down":
        return H.filter(F.col("status") != "up")
    return H


def host_filter_text(H: DataFrame, q: str | None) -> DataFrame:
    q = (q or "").strip().lower()
    return H.filter(F.lower("instance").contains(q)) if q else H


def _at_least(c: str, x: float):
    return (F.col(c) >= x) & ~F.isnan(c)


def _above(c: str, x: float):
    return (F.col(c) > x) & ~F.isnan(c)


def host_filter_risk(H: DataFrame, risk: str | None) -> DataFrame:
    if risk == "high_cpu":
        return H.filter(_at_least("cpu", 80))
    if risk == "high_memory":
        return H.filter(_at_least("memory", 85))
    return H


def host_filter_group(H: DataFrame, members: DataFrame, group_id: int | None) -> DataFrame:
    """Members of a group (semi join); a group with no members yields no hosts."""
    if group_id is None:
        return H
    m = members.filter(F.col("group_id") == group_id).select("instance")
    return H.join(m, "instance", "left_semi")


def _sort_cols(sort: str):
    if sort == "cpu_desc":
        return [F.col("cpu").desc(), F.col("instance")]
    if sort == "memory_desc":
        return [F.col("memory").desc(), F.col("instance")]
    return [F.col("instance")]


def host_list(H: DataFrame, members: DataFrame | None = None, status: str | None = None, q: str | None = None,
              risk: str | None = None, group_id: int | None = None, sort: str = "instance") -> DataFrame:
    """group -> status -> text -> risk -> sort (unknown sort falls back to instance)."""
    h = H
    if group_id is not None and members is not None:
        h = host_filter_group(h, members, group_id)
    h = host_filter_risk(host_filter_text(host_filter_status(h, status), q), risk)
    return h.orderBy(*_sort_cols(sort))


def overview(H: DataFrame, active: DataFrame, generated_us: int) -> DataFrame:
    """Fleet totals in one aggregation over hosts UNION active alerts (no cross join).

    down = not up (unknown counts as down); averages over up hosts only, 0 when none.
    """
    u = (H.select(F.lit(0).alias("_kind"), "status", "cpu", "memory")
         .unionByName(active.select(F.lit(1).alias("_kind")), allowMissingColumns=True))
    is_host = F.col("_kind") == 0
    up = is_host & (F.col("status") == "up")
    return u.agg(
        F.count_if(is_host).alias("total_hosts"),
        F.count_if(up).alias("healthy_hosts"),
        F.count_if(is_host & ~(F.col("status") == "up")).alias("down_hosts"),
        F.count_if(F.col("_kind") == 1).alias("active_alerts"),
        F.coalesce(F.avg(F.when(up, F.col("cpu"))), F.lit(0.0)).alias("avg_cpu"),
        F.coalesce(F.avg(F.when(up, F.col("memory"))), F.lit(0.0)).alias("avg_memory"),
    ).withColumn("generated_us", F.lit(generated_us).cast("bigint"))


def top_hosts(H: DataFrame, n: int = 12) -> DataFrame:
    """Top ``n`` by max(cpu, memory) — a top-k report (TakeOrderedAndProject, no global sort)."""
    return (H.withColumn("peak", F.greatest("cpu", "memory"))
            .orderBy(F.col("peak").desc(), F.col("instance")).limit(n))


def host_risk(H: DataFrame) -> DataFrame:
    """risk = normal / cpu / memory / both (cpu >= 80, memory >= 85)."""
    c = _at_least("cpu", 80)
    m = _at_least("memory", 85)
    return H.withColumn("risk", F.when(c & m, "both").when(c, "cpu").when(m, "memory").otherwise("normal"))


def host_risk_counts(H: DataFrame) -> DataFrame:
    return host_risk(H).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


def host_band(H: DataFrame) -> DataFrame:
    """Display bands: cpu >= 80 danger, > 60 warning; memory >= 85 danger, > 70 warning."""
    return (H.withColumn("cpu_band", F.when(_at_least("cpu", 80), "danger").when(_above("cpu", 60), "warning")
                         .otherwise("normal"))
            .withColumn("memory_band", F.when(_at_least("memory", 85), "danger")
                        .when(_above("memory", 70), "warning").otherwise("normal")))


def group_members(groups: DataFrame, members: DataFrame, with_list: bool = True) -> DataFrame:
    """Groups with member_count (0 for empty groups) and the sorted member list, id order."""
    agg = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        *([F.array_sort(F.collect_list("instance")).alias("members")] if with_list else []))
    g = groups.join(agg, groups["id"] == agg["group_id"], "left").drop("group_id")
    g = g.withColumn("member_count", F.coalesce("member_count", F.lit(0)).cast("bigint"))
    if with_list:
        g = g.withColumn("members", F.coalesce("members", F.array().cast("array<string>")))
    return g.orderBy("id")


NAME_MAX, MEMBER_MAX, DESCRIPTION_MAX = 128, 256, 512


def group_normalise(rows: DataFrame) -> DataFrame:
    """Requests to save groups, one row per member ``(id, group_id, name, instance[, description])``.

    Names, members and descriptions lose white space at their ends; of equal members the first
    (by id) stays. Limits in bytes: name 1-128, member 1-256, description at most 512. One bad
    row rejects all rows of its group; ``reason`` says why (NULL when valid)."""
    r = rows.withColumn("instance", trim_space(F.coalesce("instance", F.lit("")))).withColumn("name", trim_space(F.coalesce("name", F.lit(""))))
    size = F.octet_length
    bad = (F.when(~size("name").between(1, NAME_MAX), "name must be 1-128 characters")
           .when(~size("instance").between(1, MEMBER_MAX), "instance must be 1-256 characters"))
    if "description" in rows.columns:
        r = r.withColumn("description", trim_space(F.coalesce("description", F.lit(""))))
        bad = bad.when(size("description") > DESCRIPTION_MAX, "description must be at most 512 characters")
    reasons = r.groupBy("group_id").agg(F.min(bad).alias("reason"))
    w = Window.partitionBy("group_id", "instance").orderBy("id")
    first = r.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
    return first.join(reasons, "group_id", "left").withColumn("valid", F.col("reason").isNull())


def host_status_changes(snapshots: DataFrame, ts: str = "eval_us") -> DataFrame:
    """Status transitions per host over a series of snapshots (old -> new)."""
    w = Window.partitionBy("instance").orderBy(ts)
    return (snapshots.withColumn("old_status", F.lag("status").over(w))
            .filter(F.col("old_status").isNotNull() & (F.col("old_status") != F.col("status")))
            .select("instance", "old_status", F.col("status").alias("new_status"), F.col(ts).alias("changed_us")))


def host_snapshots_over_time(S: DataFrame, start_us: int, end_us: int, step: str | int,
                             lookback: str | int = "5m") -> DataFrame:
    """Snapshot at every tick (grid form of ``host_snapshot``), for status histories."""
    from vigil.operators.series import range_vector_grid
    lb = dur_us(lookback)
    s = S.filter(F.col("metric").isin(CPU, MEMORY) | ((F.col("metric") == UP)
                                                      & (F.element_at("labels", F.lit("job")) == UP_JOB)))
    g = range_vector_grid(s, start_us, end_us, step, lb)

    def pick(m, c):
        return F.max(F.when(F.col("metric") == m, F.col(c)))

    h = g.groupBy("instance", "eval_us").agg(pick(UP, "value").alias("_u"), pick(CPU, "value").alias("cpu"),
                                             pick(MEMORY, "value").alias("memory"))
    st = F.when(F.col("_u").isNull(), "unknown").when(F.col("_u") >= 1, "up").otherwise("down")
    return h.select("instance", "eval_us", F.coalesce("cpu", F.lit(0.0)).alias("cpu"),
                    F.coalesce("memory", F.lit(0.0)).alias("memory"), st.alias("status"))
