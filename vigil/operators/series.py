"""Series selection, instant / range lookups and PromQL-style vector functions.

Samples: ``metric, labels MAP, instance, series, t_us, value[, event_id]`` where ``series``
is the canonical identity (metric + sorted labels). Lookback and rate never use a range
join: each sample is exploded onto the evaluation ticks it can serve (at most
``lookback/step + 1``), after collapsing each series to its newest sample per step so the
explosion is bounded by ``series x ticks``, not by sample density.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.labels import label, matcher
from vigil.functions.timeutil import dur_us
from vigil.operators.scans import keyed_lag

SERIES_COLS = ["metric", "instance", "series"]
#: Tasks that put the samples of a series and step in order, at least: whole samples are sorted there.
#: Above 200 Spark's shuffle writers would hold and sort what they write.
STEP_PARTS = 192


def select_series(S: DataFrame, metric: str | None = None,
                  matchers: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """``metric{k op "v", ...}``; ``instance`` is a real column so it prunes at the scan."""
    cond = F.lit(True)
    if metric is not None:
        cond = cond & (F.col("metric") == metric)
    for k, op, v in matchers:
        if k == "instance" and op == "=":
            cond = cond & (F.col("instance") == v)
        else:
            cond = cond & matcher("labels", k, op, v)
    return S.filter(cond)


def instant_vector(S: DataFrame, at_us: int, lookback: str | int = "5m") -> DataFrame:
    """Newest sample per series with ``at - lookback <= t <= at``; eval time = ``at``.
    A series has at most one sample per timestamp (the TSDB invariant), so ordering by
    ``t_us`` alone is exact and the aggregation buffers stay fixed-width (hash aggregate)."""
    lb = dur_us(lookback)
    w = S.filter((F.col("t_us") >= at_us - lb) & (F.col("t_us") <= at_us))
    return (w.groupBy(*SERIES_COLS, "labels")
            .agg(F.max_by("value", "t_us").alias("value"), F.max("t_us").alias("sample_us"))
            .select(*SERIES_COLS, "labels", F.lit(at_us).cast("bigint").alias("eval_us"), "value", "sample_us"))


def _grid_check(start_us: int, end_us: int, step_us: int) -> None:
    if end_us <= start_us:
        raise ValueError("end must be after start")
    if step_us <= 0:
        raise ValueError("step must be positive")


def _first_tick(t: Column, start_us: int, step_us: int) -> Column:
    """Smallest grid tick ``start + i*step >= t`` (ticks before start are clipped to start)."""
    i = F.greatest(F.lit(0), F.ceil((t - F.lit(start_us)) / F.lit(step_us)).cast("bigint"))
    return F.lit(start_us) + i * F.lit(step_us)


def _last_tick(t: Column, start_us: int, step_us: int, end_us: int) -> Column:
    """Largest grid tick ``<= min(t, end)``."""
    x = F.least(t, F.lit(end_us))
    return F.lit(start_us) + F.floor((x - F.lit(start_us)) / F.lit(step_us)).cast("bigint") * F.lit(step_us)


def range_vector_grid(S: DataFrame, start_us: int, end_us: int, step: str | int,
                      lookback: str | int = "5m") -> DataFrame:
    """Instant lookup at every tick of ``[start, end]`` (a range query's matrix, long form)."""
    step_us, lb = dur_us(step), dur_us(lookback)
    _grid_check(start_us, end_us, step_us)
    keys = [*SERIES_COLS, "labels"]
    s = S.filter((F.col("t_us") >= start_us - lb) & (F.col("t_us") <= end_us))
    s = s.withColumn("_t0", _first_tick(F.col("t_us"), start_us, step_us))
    # Combiner: only the newest sample of a series before each tick can ever win.
    s = (s.groupBy(*keys, "_t0")
         .agg(F.max_by("value", "t_us").alias("value"), F.max("t_us").alias("t_us")))
    s = s.withColumn("_t1", _last_tick(F.col("t_us") + F.lit(lb), start_us, step_us, end_us))
    s = s.filter(F.col("_t0") <= F.col("_t1"))
    s = s.withColumn("eval_us", F.explode(F.sequence("_t0", "_t1", F.lit(step_us))))
    return (s.groupBy(*keys, "eval_us")
            .agg(F.max_by("value", "t_us").alias("value"), F.max("t_us").alias("sample_us"))
            .select(*SERIES_COLS, "labels", "eval_us", "value", "sample_us"))


def latest_point(V: DataFrame, by: Sequence[str] = ("series",), ts: str = "eval_us") -> DataFrame:
    """Last non-null value per series (what a dashboard stat panel shows)."""
    return (V.filter(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy(*by).agg(F.max_by("value", ts).alias("value"), F.max(ts).alias(ts)))


def label_values(S: DataFrame, key: str, metric: str | None = None,
                 matchers: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    s = select_series(S, metric, matchers)
    v = F.element_at("labels", F.lit(key))
    return s.select(v.alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value")


def disk_by_mount(V: DataFrame, instance: str, mountpoint: str) -> DataFrame:
    return V.filter((F.col("metric") == "disk_usage_percent") & (F.col("instance") == instance)
                    & (label("labels", "mountpoint") == mountpoint))


def disk_max(V: DataFrame) -> DataFrame:
    """``max by (instance)`` of the disk usage vector."""
    return (V.filter(F.col("metric") == "disk_usage_percent")
            .groupBy("instance", "eval_us").agg(_AGG["max"]("value").alias("value")))


# ---------------------------------------------------------------- counters and rate

def counter_accumulate(raw: DataFrame, keys: Sequence[str], ts: str = "t_us", tie: str = "event_id",
                       value: str = "value") -> DataFrame:
    """Raw OS counter -> monotone total: the first sample adds its value, a decrease is a
    reset and adds the current value, otherwise the delta is added."""
    from vigil.operators.scans import keyed_running_sum
    d = keyed_lag(raw, keys, ts, tie, [value])
    prev = F.col("prev_" + value)
    was_reset = prev.isNotNull() & (F.col(value) < prev)
    inc = F.when(prev.isNull() | was_reset, F.col(value)).otherwise(F.col(value) - prev)
    d = d.withColumn("_inc", inc).withColumn("was_reset", was_reset)
    d = keyed_running_sum(d, keys, ts, tie, "_inc", "total")
    return d.select(*keys, ts, tie, value, "total", "was_reset")


def _window_stats(S: DataFrame, start_us: int, end_us: int, step_us: int, win_us: int, resets: bool = True) -> DataFrame:
    """Per (series, tick): n, first/last sample, min/max/sum and the reset correction inside
    ``[tick - win, tick]``.

    When ``win`` is a multiple of ``step`` the samples are first reduced to one summary per
    (series, step) — steps are ``(T_{k-1}, T_k]`` — and the summaries, not the samples, are
    exploded onto the ``win/step`` ticks that contain them. A step's last sample lying
    exactly on a grid point is also the closed left edge of a later window; it is carried
    as an extra "edge" row. Resets inside a step are summed once, by an ordered pass inside
    (series, step); the reset between a step's first sample and its predecessor, which comes
    from the summaries, counts only while that predecessor is still inside the window. All buffers are fixed-width (hash aggregation). Without ``resets`` the
    ordered pass for the previous sample is left out.
    """
    tie = "event_id" if "event_id" in S.columns else "value"
    s = S.filter((F.col("t_us") >= start_us - win_us) & (F.col("t_us") <= end_us))
    if win_us % step_us != 0:
        if resets:
            s = keyed_lag(s, ["series"], "t_us", tie, ["value"])
        else:
            s = s.withColumn("prev_t_us", F.lit(None).cast("bigint")).withColumn("prev_value", F.lit(None).cast("double"))
        return _window_stats_samples(s, start_us, end_us, step_us, win_us)
    m = win_us // step_us
    kmax = (end_us - start_us) // step_us
    keys = [*SERIES_COLS, "labels"]
    s = s.withColumn("_b", F.ceil((F.col("t_us") - F.lit(start_us)) / F.lit(step_us)).cast("bigint"))
    inner = F.lit(0.0)
    if resets:
        s = s.repartition(max(STEP_PARTS, int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "series", "_b")
        s = s.withColumn("_prev", F.lag("value").over(Window.partitionBy("series", "_b").orderBy("t_us", tie)))
        inner = F.sum(F.when(F.col("value") < F.col("_prev"), F.col("_prev")).otherwise(F.lit(0.0)))
    b = (s.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
        F.min_by("value", "t_us").alias("first_v"), F.max_by("value", "t_us").alias("last_v"), inner.alias("inner"),
        F.min("value").alias("min_v"), _AGG["max"]("value").alias("max_v"), F.sum("value").alias("sum_v")))
    # The sample before a step's first one is the last of the step before that has any.
    steps = Window.partitionBy("series").orderBy("_b")
    for out, c in (("bp_t", "last_us"), ("bp_v", "last_v")):
        b = b.withColumn(out, F.lag(c).over(steps) if resets else F.lit(None).cast("double"))
    tick = lambda k: F.lit(start_us) + k * F.lit(step_us)
    full_lo = F.greatest(F.col("_b"), F.lit(0))
    full_hi = F.least(F.col("_b") + F.lit(m - 1), F.lit(kmax))
    on_grid = F.col("last_us") == tick(F.col("_b"))
    edge_k = F.col("_b") + F.lit(m)
    spans = F.concat(
        F.when(full_lo <= full_hi, F.transform(F.sequence(full_lo, full_hi), lambda k: F.struct(k.alias("k"), F.lit(False).alias("e"))))
        .otherwise(F.array().cast("array<struct<k:bigint,e:boolean>>")),
        F.when(on_grid & (edge_k >= 0) & (edge_k <= kmax), F.array(F.struct(edge_k.alias("k"), F.lit(True).alias("e"))))
        .otherwise(F.array().cast("array<struct<k:bigint,e:boolean>>")))
    x = b.select("*", F.inline(spans))
    e = F.col("e")
    x = x.select(
        *keys, tick(F.col("k")).alias("eval_us"),
        F.when(e, 1).otherwise(F.col("n")).alias("n"),
        F.when(e, F.col("last_us")).otherwise(F.col("first_us")).alias("first_us"),
        F.when(e, F.col("last_v")).otherwise(F.col("first_v")).alias("first_v"),
        "last_us", "last_v",
        F.when(e, 0.0).otherwise(F.col("inner")).alias("inner"),
        F.when(~e & F.col("bp_v").isNotNull() & (F.col("first_v") < F.col("bp_v")), F.col("bp_t")).alias("rb_t"),
        F.col("bp_v").alias("rb_v"),
        F.when(e, F.col("last_v")).otherwise(F.col("min_v")).alias("min_v"),
        F.when(e, F.col("last_v")).otherwise(F.col("max_v")).alias("max_v"),
        F.when(e, F.col("last_v")).otherwise(F.col("sum_v")).alias("sum_v"))
    boundary = F.when(F.col("rb_t").isNotNull() & (F.col("rb_t") >= F.col("eval_us") - F.lit(win_us)),
                      F.col("rb_v")).otherwise(F.lit(0.0))
    return (x.groupBy(*keys, "eval_us")
            .agg(F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
                 F.min_by("first_v", "first_us").alias("first_v"), F.max_by("last_v", "last_us").alias("last_v"),
                 (F.sum("inner") + F.sum(boundary)).alias("resets"),
                 F.min("min_v").alias("min_v"), _AGG["max"]("max_v").alias("max_v"), F.sum("sum_v").alias("sum_v")))


def _window_stats_samples(s: DataFrame, start_us: int, end_us: int, step_us: int, win_us: int) -> DataFrame:
    """Sample-level form (windows that are not a multiple of the step)."""
    s = s.withColumn("_t0", _first_tick(F.col("t_us"), start_us, step_us))
    s = s.withColumn("_t1", _last_tick(F.col("t_us") + F.lit(win_us), start_us, step_us, end_us))
    s = s.filter(F.col("_t0") <= F.col("_t1"))
    s = s.withColumn("eval_us", F.explode(F.sequence("_t0", "_t1", F.lit(step_us))))
    reset = (F.col("prev_value").isNotNull() & (F.col("value") < F.col("prev_value"))
             & (F.col("prev_t_us") >= F.col("eval_us") - F.lit(win_us)))
    return (s.groupBy(*SERIES_COLS, "labels", "eval_us")
            .agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
                 F.min_by("value", "t_us").alias("first_v"), F.max_by("value", "t_us").alias("last_v"),
                 F.sum(F.when(reset, F.col("prev_value")).otherwise(F.lit(0.0))).alias("resets"),
                 F.min("value").alias("min_v"), _AGG["max"]("value").alias("max_v"),
                 F.sum("value").alias("sum_v")))


def _extrapolated(st: DataFrame, win_us: int, is_rate: bool, is_counter: bool = True) -> DataFrame:
    """The extrapolation rule of ``rate``/``increase``."""
    result = (F.col("last_v") - F.col("first_v") + (F.col("resets") if is_counter else F.lit(0.0)))
    ds = (F.col("first_us") - (F.col("eval_us") - F.lit(win_us))) / 1e6
    de = (F.col("eval_us") - F.col("last_us")) / 1e6
    si = (F.col("last_us") - F.col("first_us")) / 1e6
    avg = si / (F.col("n") - 1)
    if is_counter:
        dz = si * (F.col("first_v") / F.col("_res"))
        ds = F.when((F.col("_res") > 0) & (F.col("first_v") >= 0) & (dz < ds), dz).otherwise(ds)
    thr = avg * 1.1
    ext = (si + F.when(ds < thr, ds).otherwise(avg / 2) + F.when(de < thr, de).otherwise(avg / 2))
    factor = ext / si
    if is_rate:
        factor = factor / (win_us / 1e6)
    st = st.filter((F.col("n") >= 2) & (F.col("last_us") > F.col("first_us"))).withColumn("_res", result)
    return st.withColumn("value", F.col("_res") * factor).drop("_res")


def rate(S: DataFrame, start_us: int, end_us: int, step: str | int, window: str | int = "5m") -> DataFrame:
    step_us, win_us = dur_us(step), dur_us(window)
    _grid_check(start_us, end_us, step_us)
    st = _extrapolated(_window_stats(S, start_us, end_us, step_us, win_us), win_us, True)
    return st.select(*SERIES_COLS, "labels", "eval_us", "value")


def increase(S: DataFrame, start_us: int, end_us: int, step: str | int, window: str | int = "5m") -> DataFrame:
    step_us, win_us = dur_us(step), dur_us(window)
    _grid_check(start_us, end_us, step_us)
    st = _extrapolated(_window_stats(S, start_us, end_us, step_us, win_us), win_us, False)
    return st.select(*SERIES_COLS, "labels", "eval_us", "value")


def over_time(S: DataFrame, fn: str, start_us: int, end_us: int, step: str | int,
              window: str | int = "5m") -> DataFrame:
    """``avg/min/max/sum/count_over_time(v[window])`` on the grid."""
    step_us, win_us = dur_us(step), dur_us(window)
    _grid_check(start_us, end_us, step_us)
    st = _window_stats(S, start_us, end_us, step_us, win_us, resets=False)
    val = {"avg": F.col("sum_v") / F.col("n"), "min": F.col("min_v"), "max": F.col("max_v"),
           "sum": F.col("sum_v"), "count": F.col("n").cast("double")}[fn]
    return st.select(*SERIES_COLS, "labels", "eval_us", val.alias("value"))


# ---------------------------------------------------------------- vector algebra

def _unless_nan(fn):
    """``fn`` over the numbers; NaN only when there are none."""
    def agg(c):
        col = F.col(c) if isinstance(c, str) else c
        return F.coalesce(fn(F.when(~F.isnan(col), col)), F.max(col))
    return agg


_AGG = {"sum": F.sum, "avg": F.avg, "max": _unless_nan(F.max), "min": _unless_nan(F.min),
        "count": lambda c: F.count(c).cast("double")}


def agg_by(V: DataFrame, fn: str, by: Sequence[str]) -> DataFrame:
    """``fn by (labels...) (v)``; ``by`` names columns (promote labels first with ``with_label``)."""
    return V.groupBy("eval_us", *by).agg(_AGG[fn]("value").alias("value"))


def agg_all(V: DataFrame, fn: str) -> DataFrame:
    """``fn(v)`` without grouping. An empty vector gives no row (not 0)."""
    return V.groupBy("eval_us").agg(_AGG[fn]("value").alias("value"))


def with_label(V: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        V = V.withColumn(k, label("labels", k))
    return V


_CMP = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def compare_col(value: Column, op: str, x: Column | float) -> Column:
    """IEEE comparison: with a NaN on either side only ``!=`` holds (Spark sorts NaN above all numbers)."""
    x = x if isinstance(x, Column) else F.lit(float(x))
    nan = F.isnan(value) | F.isnan(x)
    return F.when(nan, F.lit(op == "!=")).otherwise(_CMP[op](value, x))


def compare_filter(V: DataFrame, op: str, x: float) -> DataFrame:
    """``v > x`` keeps the matching series with their value."""
    return V.filter(compare_col(F.col("value"), op, x))


def scalar_arith(V: DataFrame, expr: str) -> DataFrame:
    """Column arithmetic on ``value`` (e.g. ``"100 - value * 100"``); drops the metric name."""
    out = V.withColumn("value", F.expr(expr).cast("double"))
    return out.withColumn("metric", F.lit(None).cast("string")) if "metric" in V.columns else out


def _div(a: Column, b: Column) -> Column:
    """Float division with IEEE results (x/0 = +-Inf, 0/0 = NaN, NaN on either side = NaN) under ANSI mode."""
    return (F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).when(b != 0, a / b)
            .when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
            .otherwise(F.lit(float("nan"))))


def vector_div(A: DataFrame, B: DataFrame, on: Sequence[str]) -> DataFrame:
    """One-to-one ``A / B`` matched on ``eval_us`` + ``on``; unmatched sides vanish. A match
    group with several series on a side is an error that ends the query, as the pairing
    would be arbitrary."""
    keys = ["eval_us", *on]

    def one(V: DataFrame, out: str) -> DataFrame:
        g = V.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("value").alias(out))
        bad = F.raise_error(F.lit("vector_div: several series of one side share a match group"))
        return g.select(*keys, F.when(F.col("_n") == 1, F.col(out)).otherwise(bad.cast("double")).alias(out))

    a, b = one(A, "_a"), one(B, "_b")
    return a.join(b, keys).select(*keys, _div(F.col("_a"), F.col("_b")).alias("value"))


def and_on(A: DataFrame, B: DataFrame, on: Sequence[str]) -> DataFrame:
    """``A and on(...) B``: rows of A whose label values exist in B at the same tick."""
    keys = ["eval_us", *on]
    return A.join(B.select(*keys), keys, "left_semi")


def unless(A: DataFrame, B: DataFrame, on: Sequence[str]) -> DataFrame:
    keys = ["eval_us", *on]
    return A.join(B.select(*keys), keys, "left_anti")


def or_(A: DataFrame, B: DataFrame, on: Sequence[str]) -> DataFrame:
    """``A or B``: all of A plus rows of B whose label values A lacks at that tick."""
    return A.unionByName(unless(B, A, on), allowMissingColumns=True)


def topk(V: DataFrame, k: int, by: Sequence[str] = (), salt: int = 64) -> DataFrame:
    """``topk(k, v)`` per tick (and ``by`` groups); NaN ranks last, ties are broken by series text.

    Two phases so a tick with millions of series is never ranked in one task: top-k
    inside ``salt`` hash slices of each tick, then top-k over the at most ``k * salt``
    survivors. Exact, because the overall top-k lies inside the union of slice top-k's."""
    order = [F.isnan("value"), F.col("value").desc(), F.col("series")]
    s = V.withColumn("_salt", F.pmod(F.xxhash64("series"), F.lit(salt)))
    pre = (s.withColumn("_r", F.row_number().over(Window.partitionBy("eval_us", *by, "_salt").orderBy(*order)))
           .filter(F.col("_r") <= k))
    w = Window.partitionBy("eval_us", *by).orderBy(*order)
    return pre.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r", "_salt")


# ---------------------------------------------------------------- named metric catalogue

# Closed catalogue: name -> (metric, kind). kind "gauge" = plain selection, "rate" = 5m rate,
# "disk" = mountpoint series or max by instance, "hosts"/"alerts" = fleet selections (fixed values).
CATALOGUE = {
    "cpu_usage": ("cpu_usage_percent", "gauge"),
    "memory_usage": ("memory_usage_percent", "gauge"),
    "memory_total": ("memory_total_bytes", "gauge"),
    "memory_available": ("memory_available_bytes", "gauge"),
    "disk_usage": ("disk_usage_percent", "disk"),
    "network_recv": ("network_recv_bytes_total", "rate"),
    "network_sent": ("network_sent_bytes_total", "rate"),
    "load1": ("load1", "gauge"),
    "load5": ("load5", "gauge"),
    "load15": ("load15", "gauge"),
    "process_count": ("process_count", "gauge"),
    "uptime": ("uptime_seconds", "gauge"),
    "host_list": ("up", "hosts"),
    "active_alerts": ("ALERTS", "alerts"),
}
NEEDS_INSTANCE = {k for k, (_, kind) in CATALOGUE.items() if kind not in ("hosts", "alerts")}

# Host detail ranges: name -> (duration, step) (fixed values).
METRIC_RANGES = {"15m": ("15m", "15s"), "1h": ("1h", "1m"), "6h": ("6h", "5m"), "24h": ("24h", "15m")}
# The eight series of the host detail page: (result name, catalogue name).
HOST_DETAIL = [("cpu", "cpu_usage"), ("memory", "memory_usage"), ("disk", "disk_usage"),
               ("network_recv", "network_recv"), ("network_sent", "network_sent"), ("load1", "load1"),
               ("process_count", "process_count"), ("uptime", "uptime")]


def metric_catalogue(S: DataFrame, name: str, start_us: int, end_us: int, step: str | int,
                     instance: str | None = None, mountpoint: str | None = None) -> DataFrame:
    """Evaluate a catalogue entry on a grid; unknown names and a missing instance are errors."""
    if name not in CATALOGUE:
        raise ValueError(f"unknown metric: {name}")
    if name in NEEDS_INSTANCE and not instance:
        raise ValueError(f"instance is required for metric {name}")
    metric, kind = CATALOGUE[name]
    if kind == "hosts":
        sel = select_series(S, "up", [("job", "=", "probe")])
        return range_vector_grid(sel, start_us, end_us, step)
    if kind == "alerts":
        sel = select_series(S, "ALERTS", [("alertstate", "=", "firing")])
        return range_vector_grid(sel, start_us, end_us, step)
    m = [("instance", "=", instance)]
    if kind == "disk" and mountpoint:
        m.append(("mountpoint", "=", mountpoint))
    sel = select_series(S, metric, m)
    if kind == "rate":
        return rate(sel, start_us, end_us, step)
    g = range_vector_grid(sel, start_us, end_us, step)
    if kind == "disk" and not mountpoint:
        return (g.groupBy("instance", "eval_us").agg(_AGG["max"]("value").alias("value"))
                .select(F.lit(metric).alias("metric"), "instance",
                        F.concat(F.lit(metric + "{instance="), F.col("instance"), F.lit("}")).alias("series"),
                        F.create_map(F.lit("instance"), F.col("instance")).alias("labels"), "eval_us", "value"))
    return g


def host_metric_ranges(S: DataFrame, instance: str, range_name: str = "1h", now_us: int | None = None,
                       mountpoint: str | None = None) -> DataFrame:
    """The host detail page: eight named series over one of the fixed ranges. One grid lookup for
    all levels and one rate pass for all counters; without a mount, disk is the maximum."""
    if not range_name:
        range_name = "1h"
    if range_name not in METRIC_RANGES:
        raise ValueError(f"unsupported range: {range_name}")
    dur, step = METRIC_RANGES[range_name]
    end = now_us
    start = end - dur_us(dur)
    mp = (mountpoint or "").strip() or None
    kinds = {CATALOGUE[cat][0]: (name, CATALOGUE[cat][1]) for name, cat in HOST_DETAIL}
    name_of = F.element_at(F.create_map(*(F.lit(x) for m, (name, _) in kinds.items() for x in (m, name))), F.col("metric"))
    host = S.filter(F.col("instance") == instance)
    levels = host.filter(F.col("metric").isin([m for m, (_, kind) in kinds.items() if kind != "rate"]))
    disk = F.col("metric").isin([m for m, (_, kind) in kinds.items() if kind == "disk"])
    if mp:
        levels = levels.filter(~disk | (label("labels", "mountpoint") == mp))
    g = range_vector_grid(levels, start, end, step)
    if not mp:
        whole = F.concat("metric", F.lit("{instance="), "instance", F.lit("}"))
        g = g.groupBy("metric", F.when(disk, whole).otherwise(F.col("series")).alias("series"), "eval_us").agg(_AGG["max"]("value").alias("value"))
    rates = rate(host.filter(F.col("metric").isin([m for m, (_, kind) in kinds.items() if kind == "rate"])), start, end, step)
    both = g.select("metric", "series", "eval_us", "value").unionByName(rates.select("metric", "series", "eval_us", "value"))
    return both.select(name_of.alias("name"), "series", "eval_us", "value")


# ---------------------------------------------------------------- volumes and display

# File-system types that are never collected, except for the root mount (fixed values).
PSEUDO_FS = ["", "autofs", "binfmt_misc", "bpf", "cgroup", "cgroup2", "configfs", "debugfs", "devpts", "devtmpfs",
             "fusectl", "hugetlbfs", "mqueue", "nsfs", "proc", "pstore", "securityfs", "selinuxfs", "squashfs",
             "sysfs", "tmpfs", "tracefs"]


def volume_filter(partitions: DataFrame, mount: str = "mountpoint", fstype: str = "fstype") -> DataFrame:
    """Keep ``/`` always; drop pseudo file systems (case-insensitive) and blank types."""
    t = F.lower(F.coalesce(F.col(fstype), F.lit("")))
    return partitions.filter((F.col(mount) == "/") | ~t.isin(*PSEUDO_FS))


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def display_units(V: DataFrame, unit: str, col: str = "value", out: str = "text") -> DataFrame:
    """Dashboard text: percent (1 decimal + %), number (at most 1 decimal), bytes/s (B, KB, MB),
    uptime (days and hours); NULL shows as ``--``."""
    v = F.col(col)
    r1 = F.round(v, 1)
    whole = r1 == F.floor(r1)
    if unit == "percent":
        t = F.concat(_fixed(r1, 1), F.lit("%"))
    elif unit == "bytes_per_s":
        t = (F.when(v >= 1024 * 1024, F.concat(_fixed(v / 1024 / 1024, 2), F.lit(" MB/s")))
             .when(v >= 1024, F.concat(_fixed(v / 1024, 1), F.lit(" KB/s")))
             .otherwise(F.concat(_fixed(v, 0), F.lit(" B/s"))))
    elif unit == "uptime":
        days = F.floor(v / 86400).cast("bigint")
        hours = F.floor(F.pmod(v, F.lit(86400.0)) / 3600).cast("bigint")
        t = F.when(days > 0, F.format_string("%dd %dh", days, hours)).otherwise(F.format_string("%dh", hours))
    else:
        t = F.when(whole, F.floor(r1).cast("bigint").cast("string")).otherwise(r1.cast("string"))
    return V.withColumn(out, F.when(v.isNull(), F.lit("--")).otherwise(t))
