"""Histograms: observation -> cumulative buckets, and bucket interpolation quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.labels import label
from vigil.operators import series as sr

# Upper bounds of the request-duration histogram in seconds (+Inf implied) — fixed values.
DEFAULT_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]


def histogram_observe(df: DataFrame, value: str, keys: Sequence[str],
                      bounds: Sequence[float] = DEFAULT_BOUNDS) -> DataFrame:
    """Raw observations -> cumulative buckets ``(keys, le, count)`` plus ``sum`` and ``count``.

    One partial aggregation with a conditional count per bound (no row explosion), then
    the single row per key is unpivoted to the bucket rows.
    """
    bs = [float(b) for b in bounds] + [float("inf")]
    aggs = [F.count_if(F.col(value) <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(bs)]
    g = df.groupBy(*keys).agg(*aggs, F.sum(value).alias("sum"), F.count(F.lit(1)).alias("count"))
    buckets = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bs)])
    return g.select(*keys, "sum", "count", F.inline(buckets)).select(*keys, "le", F.col("n").cast("bigint").alias("bucket_count"),
                                                                        "sum", "count")


# Quantile by linear interpolation inside cumulative buckets.
_QUANTILE_SQL = """
CASE
  WHEN {phi} < 0 THEN double('-Infinity')
  WHEN {phi} > 1 THEN double('Infinity')
  WHEN size(_bk) < 2 OR NOT exists(_bk, x -> x.le = double('Infinity')) THEN double('NaN')
  ELSE _q
END"""


def histogram_quantile(B: DataFrame, phi: float, by: Sequence[str], le: str = "le",
                       count: str = "value") -> DataFrame:
    """``histogram_quantile(phi, B)``: B has one row per (by..., eval_us, le) with a cumulative
    ``count``. Groups hold one row per bucket, so collecting a group is bounded by the
    number of bounds."""
    keys = ["eval_us", *by] if "eval_us" in B.columns else list(by)
    g = B.groupBy(*keys, le).agg(F.sum(count).alias("_c"))  # equal bounds are merged
    g = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"),
                                                                  F.col("_c").alias("c")))).alias("_bk"))
    # running max makes counts non-decreasing
    g = g.withColumn("_cm", F.expr(
        "transform(_bk, (x, i) -> aggregate(slice(_bk, 1, i + 1), double('-Infinity'), (a, y) -> greatest(a, y.c)))"))
    g = g.withColumn("_n", F.size("_bk"))
    g = g.withColumn("_tot", F.expr("try_element_at(_cm, -1)"))
    g = g.withColumn("_rank", F.lit(phi) * F.col("_tot"))
    g = g.withColumn("_b", F.expr(
        "coalesce(try_element_at(filter(sequence(0, greatest(_n - 2, 0)), "
        "i -> i < _n - 1 AND try_element_at(_cm, i + 1) >= _rank), 1), _n - 1)"))
    # 1-based safe reads: le(i) / cm(i) of the 0-based bucket index i
    le_b = "try_element_at(_bk, _b + 1).le"
    le_p = "coalesce(try_element_at(_bk, _b).le, 0D)"
    cm_b = "try_element_at(_cm, _b + 1)"
    cm_p = "coalesce(try_element_at(_cm, _b), 0D)"
    q = F.expr(f"""
      CASE
        WHEN _n < 2 THEN double('NaN')
        WHEN _tot = 0 THEN double('NaN')
        WHEN _b = _n - 1 THEN try_element_at(_bk, _n - 1).le
        WHEN _b = 0 AND try_element_at(_bk, 1).le <= 0 THEN try_element_at(_bk, 1).le
        ELSE (CASE WHEN _b = 0 THEN 0D ELSE {le_p} END)
             + ({le_b} - CASE WHEN _b = 0 THEN 0D ELSE {le_p} END)
               * ((_rank - CASE WHEN _b = 0 THEN 0D ELSE {cm_p} END)
                  / ({cm_b} - CASE WHEN _b = 0 THEN 0D ELSE {cm_p} END))
      END""")
    g = g.withColumn("_q", q)
    return g.select(*keys, F.expr(_QUANTILE_SQL.format(phi=float(phi))).alias("value"))


def _http_rate(S: DataFrame, start_us: int, end_us: int, step: str, matchers=()) -> DataFrame:
    s = sr.select_series(S, "http_requests_total", [("job", "=", "web"), *matchers])
    return sr.rate(s, start_us, end_us, step, "5m")


def error_ratio(S: DataFrame, start_us: int, end_us: int, step: str = "1m", threshold: float | None = 0.05) -> DataFrame:
    """``sum by (instance) 5xx rate / sum by (instance) rate > threshold and on(instance) total > 0``."""
    r = _http_rate(S, start_us, end_us, step)
    failed = F.when(label("labels", "status").rlike("^5..$"), F.col("value"))
    g = r.groupBy("eval_us", "instance").agg(F.sum(failed).alias("_e"), F.sum("value").alias("_t")).filter(F.col("_e").isNotNull())
    g = g.filter(sr.compare_col(F.col("_t"), ">", 0)).select("eval_us", "instance", sr._div(F.col("_e"), F.col("_t")).alias("value"))
    return g if threshold is None else sr.compare_filter(g, ">", threshold)


def p95_latency(S: DataFrame, start_us: int, end_us: int, step: str = "1m", phi: float = 0.95,
                threshold: float | None = 1.0) -> DataFrame:
    """``histogram_quantile(phi, sum by (instance, le) (rate(bucket[5m]))) > threshold``."""
    b = sr.select_series(S, "http_request_duration_seconds_bucket", [("job", "=", "web")])
    r = sr.rate(b, start_us, end_us, step, "5m").withColumn("le", label("labels", "le").cast("double"))
    s = r.groupBy("eval_us", "instance", "le").agg(F.sum("value").alias("value"))
    q = histogram_quantile(s, phi, ["instance"])
    return q if threshold is None else sr.compare_filter(q, ">", threshold)


def request_rate_by_route(S: DataFrame, start_us: int, end_us: int, step: str = "1m") -> DataFrame:
    """Request rate summed by (path, status) and by instance, tagged by ``view``."""
    r = sr.with_label(_http_rate(S, start_us, end_us, step), "path", "status")
    a = sr.agg_by(r, "sum", ["path", "status"]).select(F.lit("route").alias("view"), "eval_us",
                                                       F.concat_ws(" ", "path", "status").alias("key"), "value")
    b = sr.agg_by(r, "sum", ["instance"]).select(F.lit("instance").alias("view"), "eval_us",
                                                 F.col("instance").alias("key"), "value")
    return a.unionByName(b)


def pipeline_rates(S: DataFrame, metric: str, by: Sequence[str], start_us: int, end_us: int,
                   step: str = "1m") -> DataFrame:
    """Event-pipeline counters: ``sum by (by...) (rate(metric[5m]))``."""
    r = sr.with_label(sr.rate(sr.select_series(S, metric), start_us, end_us, step, "5m"), *by)
    return sr.agg_by(r, "sum", list(by))
