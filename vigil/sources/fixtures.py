"""Logical tables (FIXTURES.md) derived from the driver's parquet tables.

The driver ships a generic ``events`` table; these views re-time it (30 days -> 72
minutes, so real scrape intervals apply) and shape it into metric samples, requests,
logs and alert events. Each derivation has a DuckDB twin in ``vigil.plans.fixture_sql``.
All are lazy DataFrames over the parquet scan, so filters and column pruning reach
the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.labels import series_key
from vigil.functions.timeutil import MIN
from vigil.operators.scans import keyed_running_sum, keyed_running_sums

# Fixed values of the fixture definition (FIXTURES.md §B).
T0_US = 1_704_067_200_000_000          # 2024-01-01T00:00:00Z
TIME_COMPRESSION = 600                 # 30 days -> 72 minutes
EVAL_END_US = T0_US + 72 * MIN
N_HOSTS = 25
COUNTER_WRAP = 50_000
MOUNTPOINTS = ["/", "/data", "/var"]
SEVERITIES = ["critical", "warning", "info"]   # k % 4 = 3 -> no severity label
SERVICES = ["web", "alert", "probe"]
COLLECTORS = ["cpu", "memory", "disk", "network", "load"]
PROBE_JOB = "probe"
WEB_JOB = "web"
# Request paths by k % 5 (index 2 is expanded with the instance).
PATHS = ["/api/v1/hosts", "/api/v1/alerts", "/api/v1/hosts/{instance}/metrics", "/ws/monitor", "/metrics"]
# Upper bounds of the request-duration histogram (seconds); +Inf is implied.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_of(table(spark, sf_dir, "events"))


def base_of(ev: DataFrame) -> DataFrame:
    """Re-timed events (batch or streaming ``events`` rows)."""
    t_us = F.lit(T0_US) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {T0_US}) div {TIME_COMPRESSION}")
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        t_us.cast("bigint").alias("t_us"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("host-"), (F.col("user_id") % N_HOSTS).cast("string")).alias("instance"),
    )


def _labels(**kv) -> F.Column:
    args = []
    for k, v in kv.items():
        args += [F.lit(k), v if isinstance(v, F.Column) else F.lit(v)]
    return F.create_map(*args)


def _sample(df: DataFrame, metric: str, labels: F.Column, value: F.Column) -> DataFrame:
    return (df.select(F.lit(metric).alias("metric"), labels.alias("labels"), "instance", "t_us",
                      value.cast("double").alias("value"), "event_id")
            .withColumn("series", series_key("metric", "labels")))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = events_base(spark, sf_dir)
    inst = F.col("instance")
    cpu = _sample(b.filter(F.col("event_type") == "view"), "cpu_usage_percent",
                  _labels(instance=inst, job=PROBE_JOB), F.col("value") % 100)
    mem = _sample(b.filter(F.col("event_type") == "click"), "memory_usage_percent",
                  _labels(instance=inst, job=PROBE_JOB), F.col("value") % 100)
    mount = F.element_at(F.array(*[F.lit(m) for m in MOUNTPOINTS]), (F.col("k") % 3 + 1).cast("int"))
    disk = _sample(b.filter(F.col("event_type") == "purchase"), "disk_usage_percent",
                   _labels(instance=inst, job=PROBE_JOB, mountpoint=mount), F.col("value") % 100)
    up = _sample(b.filter(F.col("event_type") == "error"), "up",
                 _labels(instance=inst, job=PROBE_JOB), F.when(F.col("value") > 100, 0).otherwise(1))
    return cpu.unionByName(mem).unionByName(disk).unionByName(up)


def raw_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw network byte counters that wrap at ``COUNTER_WRAP`` (a reset on every wrap)."""
    b = events_base(spark, sf_dir).filter(F.col("event_type") == "signup")
    b = b.select("event_id", "instance", "t_us",
                 F.concat(F.lit("eth"), (F.col("k") % 2).cast("string")).alias("iface"),
                 F.round(F.col("value") * 100).cast("bigint").alias("_inc"))
    run = keyed_running_sum(b, ["instance", "iface"], "t_us", "event_id", "_inc", "_run")
    return run.select("instance", "iface", "t_us", "event_id",
                      (F.col("_run") % COUNTER_WRAP).cast("double").alias("value"))


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rc = raw_counters(spark, sf_dir)
    return _sample(rc, "network_recv_bytes_total",
                   _labels(iface=F.col("iface"), instance=F.col("instance"), job=PROBE_JOB), F.col("value"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All host metric samples: gauges plus the wrapping network counter."""
    return gauges(spark, sf_dir).unionByName(counter_samples(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(events_base(spark, sf_dir))


def requests_of(b: DataFrame) -> DataFrame:
    paths = F.array(*[F.lit(p) for p in PATHS])
    path = F.replace(F.element_at(paths, (F.col("k") % 5 + 1).cast("int")), F.lit("{instance}"), F.col("instance"))
    status = (F.when((F.col("event_type") == "error") & (F.col("value") > 60), 500)
              .when(F.col("k") % 17 == 0, 404).otherwise(200))
    return b.select(
        "event_id", "t_us", "instance", "k",
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("client_ip"),
        path.alias("route"), status.cast("int").alias("status"),
        (F.col("value") / 100).alias("latency_s"),
    )


def http_counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``http_requests_total{instance,path,status}``, path being the route template: a running
    count per label set, one sample per request (the value a scrape right after it would read)."""
    from vigil.operators.logs import route_template

    r = requests(spark, sf_dir).withColumn("_one", F.lit(1).cast("bigint")).withColumn("route", route_template(F.col("route")))
    run = keyed_running_sum(r, ["instance", "route", "status"], "t_us", "event_id", "_one", "_n")
    lab = _labels(instance=F.col("instance"), job=WEB_JOB, path=F.col("route"),
                  status=F.col("status").cast("string"))
    return _sample(run, "http_requests_total", lab, F.col("_n"))


def http_bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``http_request_duration_seconds_bucket{instance,le}``: cumulative bucket counters, one
    sample per request and bound (all buckets advance together, as a scrape sees them).
    The running counts are computed on the requests (one ordered pass, a column per bound)
    and only then unpivoted to bucket samples."""
    r = requests(spark, sf_dir)
    bounds = [float(x) for x in LATENCY_BOUNDS] + [float("inf")]
    for i, b in enumerate(bounds):
        r = r.withColumn(f"_h{i}", (F.col("latency_s") <= F.lit(b)).cast("bigint"))
    run = keyed_running_sums(r, ["instance"], "t_us", "event_id", [f"_h{i}" for i in range(len(bounds))])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_h{i}").alias("n")) for i, b in enumerate(bounds)])
    run = run.select("event_id", "t_us", "instance", F.inline(pairs))
    le_text = F.when(F.col("le") == float("inf"), F.lit("+Inf")).otherwise(F.col("le").cast("string"))
    lab = _labels(instance=F.col("instance"), job=WEB_JOB, le=le_text)
    return _sample(run, "http_request_duration_seconds_bucket", lab, F.col("n"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(requests(spark, sf_dir))


def logs_of(r: DataFrame, *keep: str) -> DataFrame:
    """Log rows of requests; ``keep`` names request columns to carry along."""
    level = F.when(F.col("status") >= 500, "error").when(F.col("status") >= 400, "warn").otherwise("info")
    service = F.element_at(F.array(*[F.lit(s) for s in SERVICES]), (F.col("k") % 3 + 1).cast("int"))
    msg = (F.when(F.col("status") >= 500, F.lit("kafka publish failed"))
           .when(F.col("status") >= 400, F.lit("route not found")).otherwise(F.lit("request completed")))
    trace = F.when(F.col("k") % 4 != 0, F.md5((F.col("event_id").cast("bigint") / 4).cast("bigint").cast("string")))
    collector = F.when((F.col("status") >= 500) & (F.col("k") % 3 == 2),
                       F.element_at(F.array(*[F.lit(c) for c in COLLECTORS]), (F.col("k") % 5 + 1).cast("int")))
    h = F.md5(F.col("event_id").cast("string"))
    k, st = F.col("k"), F.col("status")
    error = (F.when((st >= 500) & (k % 7 == 0),
                    F.concat(F.lit("dial postgres://app:"), F.substring(h, 1, 12), F.lit("@db:5432/metrics: timeout")))
             .when((st >= 500) & (k % 7 == 1), F.concat(F.lit("upstream 401 Authorization: Bearer "), h))
             .when(st >= 500, F.lit("upstream timeout"))
             .when(k % 29 == 0, F.concat(F.lit("cookie rejected: Cookie: session="), F.substring(h, 1, 16)))
             .when(k % 31 == 0, F.concat(F.lit("bad request token="), F.substring(h, 1, 20), F.lit(" password=hunter"),
                                         k.cast("string"))))
    return r.select(
        "event_id", "t_us", F.timestamp_micros("t_us").alias("ts"), level.alias("level"), msg.alias("msg"),
        service.alias("service"), "instance", trace.alias("trace_id"),
        F.when(F.col("k") % 4 != 0, F.substring(F.md5(F.col("event_id").cast("string")), 1, 16)).alias("span_id"),
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(F.col("k") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.col("route").alias("path"), "status",
        (F.col("latency_s") * 1000).alias("latency_ms"), "client_ip",
        error.alias("error"),
        collector.alias("collector"),
        F.when(F.col("status") >= 500, "stderr").otherwise("stdout").alias("stream"), *keep,
    )


ALERT_SCHEMA_COLS = ["event_id", "fingerprint", "status", "alertname", "instance", "severity", "labels",
                     "annotations", "starts_us", "ends_us", "generator_url", "received_us"]


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert events as delivered (webhook/topic), including redeliveries."""
    return alerts_of(events_base(spark, sf_dir))


def alerts_of(b: DataFrame) -> DataFrame:
    b = b.filter(F.col("event_type").isin("error", "signup"))
    name = F.when((F.col("event_type") == "error") & (F.col("value") > 80), "HighCPU").otherwise("HighMemory")
    sev = F.when(F.col("k") % 4 < 3,
                 F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col("k") % 4 + 1).cast("int")))
    b = b.select("event_id", "t_us", "instance", "k", name.alias("alertname"), sev.alias("severity"))
    fp = F.md5(F.concat_ws("|", "instance", "alertname", (F.col("k") % 2).cast("string")))
    status = F.when(F.col("k") % 3 == 0, "resolved").otherwise("firing")
    starts = (F.col("t_us") - F.pmod(F.col("t_us"), F.lit(10 * MIN))).cast("bigint")
    labels = F.map_filter(
        F.create_map(F.lit("alertname"), F.col("alertname"), F.lit("instance"), F.col("instance"),
                     F.lit("severity"), F.col("severity")),
        lambda k, v: v.isNotNull())
    ann = F.create_map(F.lit("summary"), F.concat(F.col("alertname"), F.lit(" on "), F.col("instance")))
    a = b.select(
        "event_id", fp.alias("fingerprint"), status.alias("status"), "alertname", "instance", "severity",
        labels.alias("labels"), ann.alias("annotations"), starts.alias("starts_us"),
        F.when(status == "resolved", F.col("t_us")).cast("bigint").alias("ends_us"),
        F.lit(None).cast("string").alias("generator_url"), F.col("t_us").alias("received_us"))
    again = (a.filter(F.col("event_id") % 4 == 0)
             .withColumn("event_id", -1 - F.col("event_id"))  # below zero: no delivered id is repeated
             .withColumn("received_us", F.col("received_us") + 400 * 1_000_000))
    return a.unionByName(again)


def host_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"),
                    F.concat(F.lit("hosts of "), F.lower("r_name")).alias("description"))


def host_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("id"),
                    F.col("n_regionkey").cast("bigint").alias("group_id"),
                    F.concat(F.lit("host-"), F.col("n_nationkey").cast("string")).alias("instance"))


RULE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("matchers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("fn", T.StringType()), T.StructField("window_s", T.LongType()),
    T.StructField("agg", T.StringType()), T.StructField("by", T.ArrayType(T.StringType())),
    T.StructField("cmp", T.StringType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("for_ms", T.LongType()), T.StructField("severity", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("expr", T.StringType()), T.StructField("duration", T.StringType()),
])

# The shipped host rules, in structured form (fixed values; the description of rule 5 is our own text).
HOST_RULES = [
    (1, "HighCPU", "cpu_usage_percent", {}, "none", 0, "none", [], ">", 80.0, 120_000, "warning",
     "High CPU usage on {{ $labels.instance }}", "CPU usage is {{ $value }}% (threshold: 80%).", True,
     "cpu_usage_percent > 80", "2m"),
    (2, "CriticalCPU", "cpu_usage_percent", {}, "none", 0, "none", [], ">", 95.0, 60_000, "critical",
     "Critical CPU usage on {{ $labels.instance }}", "CPU usage is {{ $value }}% (threshold: 95%).", True,
     "cpu_usage_percent > 95", "1m"),
    (3, "HighMemory", "memory_usage_percent", {}, "none", 0, "none", [], ">", 85.0, 120_000, "warning",
     "High memory usage on {{ $labels.instance }}", "Memory usage is {{ $value }}% (threshold: 85%).", True,
     "memory_usage_percent > 85", "2m"),
    (4, "HighDisk", "disk_usage_percent", {}, "none", 0, "none", [], ">", 90.0, 300_000, "warning",
     "High disk usage on {{ $labels.instance }}",
     "Disk usage on {{ $labels.mountpoint }} is {{ $value }}% (threshold: 90%).", True,
     "disk_usage_percent > 90", "5m"),
    (5, "HostDown", "up", {"job": PROBE_JOB}, "none", 0, "none", [], "==", 0.0, 60_000, "critical",
     "Host {{ $labels.instance }} is down", "The probe on {{ $labels.instance }} cannot be reached.", True,
     "up{job=\"probe\"} == 0", "1m"),
]


# The shipped service rules: their metrics are the derived vectors of ``service_vectors`` (fixed values).
SERVICE_RULES = [
    (6, "HighErrorRate", "http_error_ratio", {}, "none", 0, "none", [], ">", 0.05, 120_000, "warning",
     "High error rate on {{ $labels.instance }}", "HTTP 5xx error rate is above 5%.", True, "http_error_ratio > 0.05", "2m"),
    (7, "HighLatency", "http_p95_latency", {}, "none", 0, "none", [], ">", 1.0, 300_000, "warning",
     "High latency on {{ $labels.instance }}", "HTTP P95 latency is above 1s.", True, "http_p95_latency > 1", "5m"),
]


def rules(spark: SparkSession, service: bool = False) -> DataFrame:
    return spark.createDataFrame(HOST_RULES + (SERVICE_RULES if service else []), RULE_SCHEMA)


def service_vectors(spark: SparkSession, sf_dir: str, start_us: int, end_us: int, step: str) -> DataFrame:
    """Error ratio (where there is traffic) and 95th percentile latency by instance, on the grid."""
    from vigil.operators import histogram as hist

    ratio = hist.error_ratio(http_counter_samples(spark, sf_dir), start_us, end_us, step, threshold=None)
    p95 = hist.p95_latency(http_bucket_samples(spark, sf_dir), start_us, end_us, step, threshold=None)
    both = ratio.select(F.lit("http_error_ratio").alias("metric"), "instance", "eval_us", "value").unionByName(
        p95.select(F.lit("http_p95_latency").alias("metric"), "instance", "eval_us", "value"))
    return both.withColumn("labels", F.create_map(F.lit("instance"), F.col("instance"))).withColumn("series", series_key("metric", "labels"))


# Channel rows added to the page URLs so every screen reason occurs (fixed values).
EXTRA_CHANNEL_URLS = [
    "http://localhost:9000/hook", "http://10.0.0.1/hook", "http://169.254.1.1/latest",
    "https://user:pw@hooks.example.com/x", "ftp://files.example.com/drop",
    "http://[::1]/x", "http://[0:0:0:0:0:0:0:1]:8080/x", "http://[::ffff:127.0.0.1]/x", "http://[::ffff:a00:1]/x",
    "http://[fe80::1]/x", "http://[fd00:1::2]/x", "http://[2001:db8::1]/x", "http://010.0.0.1/x", "http://8.8.8.8/x",
    "http://bad host/x", "\thttp://hooks.example.com/ok\n",
]


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url"))
    extra = spark.createDataFrame([(-(i + 1), u) for i, u in enumerate(EXTRA_CHANNEL_URLS)], "id bigint, url string")
    u = p.unionByName(extra)
    return u.select("id", F.concat(F.lit("channel-"), F.col("id").cast("string")).alias("name"),
                    F.lit("webhook").alias("type"), "url", (F.col("id") % 7 != 3).alias("enabled"))
