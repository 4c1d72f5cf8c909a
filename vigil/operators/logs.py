"""Logs and traces: search, volume histograms, access analysis, redaction, trace joins,
metric/log correlation and the sliding-window rate-limit audit.

Logs: ``t_us, level, msg, service, instance, trace_id, span_id, request_id, method, path,
status, latency_ms, client_ip, error, collector, stream`` (+ nested ``kubernetes``).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.timeutil import dur_us
from vigil.operators.scans import exact_percentiles, sliding_count

KEYWORD_MAX = 256
SLOW_MS = 1000.0
RATE_LIMIT = 120
RATE_WINDOW = "60s"
# Paths the request limiter never counts (fixed values).
RATE_SKIP = ["/metrics", "/healthz", "/readyz"]
RATE_PREFIXES = ["/api/", "/ws/"]

# Route templates of the web API, in match order (fixed values).
ROUTES = [
    "/api/v1/auth/login", "/api/v1/auth/me", "/api/v1/auth/register",
    "/api/v1/hosts", "/api/v1/hosts/:instance/metrics", "/api/v1/dashboard/overview",
    "/api/v1/alerts/active", "/api/v1/alerts/events", "/api/v1/alert-histories",
    "/api/v1/host-groups", "/api/v1/host-groups/:id", "/api/v1/host-groups/:id/members",
    "/api/v1/alert-rules", "/api/v1/alert-rules/sync", "/api/v1/alert-rules/:id",
    "/api/v1/channels", "/api/v1/channels/:id", "/api/v1/channels/:id/test",
    "/api/v1/users", "/api/v1/users/:id", "/api/v1/webhook/alertmanager",
    "/ws/alerts", "/metrics", "/healthz", "/readyz",
]

# Secret patterns and their masks, applied in order (Java regex; fixed values). Credentials of a
# header are masked to the end of its value.
REDACTIONS = [
    (r"([A-Za-z][A-Za-z0-9+.\-]*://[^:/@\s]+:)[^@\s]+(@)", "$1***$2"),
    (r"(?i)(authorization[\"']?\s*[:=]\s*[\"']?(?:(?:bearer|basic|digest|negotiate)\s+)?)[^\r\n\"'\\]+", "$1***"),
    (r"(?i)(cookie[\"']?\s*:\s*[\"']?)[^\r\n\"'\\]+", "$1***"),
    (r"(?i)\b(password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)(\\?[\"']?\s*[=:]\s*)(\\?[\"']?)[^\s\"'&\\,}]+", "$1$2$3***"),
]


def log_keyword(L: DataFrame, cols: Sequence[str] = ("msg", "error")) -> DataFrame:
    """Exact-match companions ``<col>_keyword``: the value only when it is at most 256
    characters (longer values are not indexed for exact match)."""
    for c in cols:
        L = L.withColumn(f"{c}_keyword", F.when(F.length(c) <= KEYWORD_MAX, F.col(c)))
    return L


def _wild(c: Column, pattern: str) -> Column:
    """Wildcard on analysed text: ``*`` and ``?``, case-insensitive."""
    like = pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    return F.lower(c).like(like.lower())


# Fields with a keyword form of at most KEYWORD_MAX characters; all others match at any length.
KEYWORD_FIELDS = ("msg", "error")


def log_condition(q: tuple) -> Column:
    """A boolean search tree as a column: ``("and" | "or", q, ...)``, ``("not", q)``, ``("exists", field)``,
    ``("is", field, value, ...)`` (exact, any of the values; msg and error by their keyword form)
    and ``("like", field, pattern, ...)`` (any of the wildcard patterns)."""
    op, args = q[0], q[1:]
    if op in ("and", "or"):
        out = F.lit(op == "and")
        for x in args:
            out = (out & log_condition(x)) if op == "and" else (out | log_condition(x))
        return out
    if op == "not":
        return ~log_condition(args[0])
    f = args[0]
    if op == "exists":
        return F.col(f).isNotNull()
    if op == "is":
        key = F.when(F.length(f) <= KEYWORD_MAX, F.col(f)) if f in KEYWORD_FIELDS else F.col(f)
        return F.coalesce(key.isin(*args[1:]), F.lit(False))
    if op == "like":
        return log_condition(("or", *(("_one", f, p) for p in args[1:])))
    if op == "_one":
        return F.coalesce(_wild(F.col(f), args[1]), F.lit(False))
    raise ValueError(f"unknown search operator {op!r}")


def log_search(L: DataFrame, fields: Mapping[str, Sequence[str]] | None = None, exists: Sequence[str] = (),
               wildcard: Mapping[str, str | Sequence[str]] | None = None, start_us: int | None = None,
               end_us: int | None = None, query: tuple | None = None) -> DataFrame:
    """Boolean field query, newest first: OR within a field's values or patterns, AND across
    fields; ``_exists_`` fields must be non-null; optional time range. ``query`` is any tree of
    ``log_condition`` and is ANDed with the rest."""
    parts = [("is", f, *values) for f, values in (fields or {}).items()] + [("exists", f) for f in exists]
    parts += [("like", f, *([p] if isinstance(p, str) else p)) for f, p in (wildcard or {}).items()]
    cond = log_condition(("and", *parts, *([query] if query else [])))
    if start_us is not None:
        cond = cond & (F.col("t_us") >= start_us)
    if end_us is not None:
        cond = cond & (F.col("t_us") <= end_us)
    return L.filter(cond).orderBy(F.col("t_us").desc(), F.col("request_id").desc())


def _bucket(step_us: int, origin_us: int = 0) -> Column:
    return F.lit(origin_us) + F.floor((F.col("t_us") - F.lit(origin_us)) / F.lit(step_us)).cast("bigint") * F.lit(step_us)


def log_volume(L: DataFrame, step: str | int, start_us: int, end_us: int, by: Sequence[str] = ()) -> DataFrame:
    """Date histogram: count per bucket of ``[start, end)``, zero buckets included (when
    ``by`` is empty). Bucket origins are aligned to ``start``."""
    step_us = dur_us(step)
    c = (L.filter((F.col("t_us") >= start_us) & (F.col("t_us") < end_us))
         .groupBy(_bucket(step_us, start_us).alias("bucket_us"), *by).agg(F.count(F.lit(1)).alias("n")))
    if by:
        return c
    n = (end_us - start_us + step_us - 1) // step_us
    grid = L.sparkSession.range(0, n).select((F.lit(start_us) + F.col("id") * F.lit(step_us)).alias("bucket_us"))
    return grid.join(c, "bucket_us", "left").select("bucket_us", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def log_level_dist(L: DataFrame, step: str | int, start_us: int = 0) -> DataFrame:
    """Per bucket and service: volume, level distribution and error rate (one aggregation)."""
    step_us = dur_us(step)
    g = L.groupBy(_bucket(step_us, start_us).alias("bucket_us"), "service").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("level") == "error").alias("n_error"),
        F.count_if(F.col("level") == "warn").alias("n_warn"),
        F.count_if(F.col("level") == "info").alias("n_info"))
    return g.withColumn("error_rate", F.col("n_error") / F.col("n"))


def http_access(L: DataFrame, slow_ms: float = SLOW_MS) -> DataFrame:
    """Request log analysis per (path, status): requests, slow requests, error logs, latency."""
    return (L.filter(F.col("status").isNotNull()).groupBy("path", "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("latency_ms") > slow_ms).alias("slow"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms")))


def http_latency(L: DataFrame) -> DataFrame:
    """Exact latency percentiles per (path, status), to the microsecond (ranks from counts per value, no group in one task)."""
    us = L.filter(F.col("status").isNotNull() & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms")).select(
        "path", "status", F.round(F.col("latency_ms") * 1000).cast("bigint").alias("us"))
    r = exact_percentiles(us, ["path", "status"], "us", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return r.select("path", "status", "n", *((F.col(c) / 1000.0).alias(f"{c}_ms") for c in ("mean", "p50", "p95", "p99", "max")))


def collector_failures(L: DataFrame) -> DataFrame:
    return (L.filter(F.col("collector").isNotNull() & (F.col("level") == "error"))
            .groupBy("collector").agg(F.count(F.lit(1)).alias("failures")))


def route_template(path: Column, routes: Sequence[str] = ROUTES) -> Column:
    """Raw path -> route template (``:param`` = one segment), raw path when unmatched.
    Compiled into one CASE expression evaluated in the JVM."""
    expr = None
    for r in routes:
        rx = "^" + re.sub(r":[A-Za-z_]+", "[^/]+", re.escape(r).replace(r"\:", ":")) + "$"
        expr = (F.when(path.rlike(rx), F.lit(r)) if expr is None else expr.when(path.rlike(rx), F.lit(r)))
    return expr.otherwise(path)


def with_route_template(L: DataFrame, path: str = "path", out: str = "route") -> DataFrame:
    return L.withColumn(out, route_template(F.col(path)))


def redact(c: Column) -> Column:
    out = c
    for rx, rep in REDACTIONS:
        out = F.regexp_replace(out, rx, rep)
    return out


def log_redact(L: DataFrame, cols: Sequence[str] = ("msg", "error")) -> DataFrame:
    """Mask credentials in text fields; ``redacted`` flags rows that had any."""
    flag = F.lit(False)
    for c in cols:
        red = redact(F.col(c))
        flag = flag | F.coalesce(red != F.col(c), F.lit(False))
        L = L.withColumn(f"_{c}_red", red)
    L = L.withColumn("redacted", flag)
    for c in cols:
        L = L.withColumn(c, F.col(f"_{c}_red")).drop(f"_{c}_red")
    return L


def log_trace_join(L: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Per trace: spans, services and time extent. With a span table, only traces that it
    holds (a semi join on the id, so neither side multiplies the other)."""
    t = L.filter(F.col("trace_id").isNotNull())
    if spans is not None:
        t = t.join(spans.select("trace_id"), "trace_id", "left_semi")
    return t.groupBy("trace_id").agg(
        F.count_distinct("span_id").alias("spans"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"))


def trace_rate(L: DataFrame, step: str | int, start_us: int = 0) -> DataFrame:
    """Distinct traces per interval."""
    step_us = dur_us(step)
    return (L.filter(F.col("trace_id").isNotNull()).groupBy(_bucket(step_us, start_us).alias("bucket_us"))
            .agg(F.count_distinct("trace_id").alias("traces")))


def trace_latency(L: DataFrame) -> DataFrame:
    """Trace duration distribution (exact percentiles of the durations)."""
    t = log_trace_join(L).select((F.col("end_us") - F.col("start_us")).alias("d_us"))
    r = exact_percentiles(t, [], "d_us", {"p50": 0.5, "p95": 0.95})
    return r.select(F.col("n").alias("traces"), *((F.col(c) / 1000.0).alias(f"{c}_ms") for c in ("mean", "p50", "p95", "max")))


def trace_sample(L: DataFrame, rate: float) -> DataFrame:
    """Ratio sampling by trace id: keep a trace when (low 8 bytes as unsigned) >> 1 is below
    ``rate * 2^63``; whole traces are kept or dropped together."""
    bound = int(rate * (1 << 63))
    low = F.conv(F.substring("trace_id", 17, 16), 16, 10).cast("decimal(20,0)")
    return L.filter(F.col("trace_id").isNotNull() & (F.floor(low / 2) < F.lit(bound).cast("decimal(20,0)")))


def metric_log_correlate(V: DataFrame, L: DataFrame, delta: str | int, value_col: str = "value") -> DataFrame:
    """Logs within ``delta`` of each metric point, same instance. Interval join without a
    range join: each point is copied to the 3 time buckets (width ``delta``) its window
    touches, then an equi-join on (instance, bucket) and an exact time filter."""
    d = dur_us(delta)
    pts = V.select("instance", F.col("eval_us").alias("point_us"), F.col(value_col).alias("point_value"),
                   F.explode(F.array([F.floor(F.col("eval_us") / d) + i for i in (-1, 0, 1)])).alias("_b"))
    lg = L.withColumn("_b", F.floor(F.col("t_us") / d))
    j = pts.join(lg, ["instance", "_b"]).filter(F.abs(F.col("t_us") - F.col("point_us")) <= d)
    return j.drop("_b")


def ratelimit_audit(requests: DataFrame, limit: int = RATE_LIMIT, window: str | int = RATE_WINDOW,
                    ip: str = "client_ip", route: str = "route") -> DataFrame:
    """Replay the sliding-window limiter: per (client ip, route) count requests in the
    closed window ``[t - window, t]`` including rejected ones and the request itself
    (same-time requests count in arrival order). The route is the template of the path, as in
    the limiter. allowed = used <= limit; remaining = max(limit - used, 0). Paths that are
    skipped are judged as they came, and not audited."""
    r = requests.filter(~F.col(route).isin(*RATE_SKIP)
                        & (F.col(route).startswith(RATE_PREFIXES[0]) | F.col(route).startswith(RATE_PREFIXES[1])))
    r = sliding_count(r.withColumn(route, route_template(F.col(route))), [ip, route], "t_us", "event_id", dur_us(window), "used")
    return (r.withColumn("allowed", F.col("used") <= limit)
            .withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).cast("bigint")))
