"""Readers for the wire formats that feed the engine: query-API responses, text
exposition, alert webhooks, the alert-event topic and container log lines.

Each parser is a ``DataFrame -> DataFrame`` over a text column, for batches and for streams. All but
``src_cri_logs`` work row by row; that one keeps the open pieces of a file as state on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.labels import series_key
from vigil.sources import topic as topics

# ---------------------------------------------------------------- query API responses

RESPONSE_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("resultType", T.StringType()),
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("metric", T.MapType(T.StringType(), T.StringType())),
            T.StructField("value", T.ArrayType(T.StringType())),
            T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
        ]))),
    ])),
])


def unix_text_to_us(c: Column) -> Column:
    """Fractional unix seconds (text) -> BIGINT micro-seconds, exact via decimal; NULL for other text."""
    return (c.try_cast("decimal(24,6)") * F.lit(1_000_000)).try_cast("bigint")


def src_query_response(text_df: DataFrame, col: str = "body") -> DataFrame:
    """Vector/matrix JSON responses -> samples. ``error`` is set (and the point fields
    NULL) when the status is not ``success`` or a point is not a ``[ts, "v"]`` pair of numbers.
    ``instance`` falls back to the ``job`` label."""
    r = text_df.select("*", F.from_json(F.col(col), RESPONSE_SCHEMA).alias("_r"))
    bad_status = F.coalesce(F.col("_r.status"), F.lit("")) != "success"
    res = r.select(
        *[c for c in text_df.columns if c != col],
        F.when(bad_status, F.concat(F.lit("query failed: "), F.coalesce("_r.error", "_r.status", F.lit("bad json"))))
        .alias("_err"),
        F.explode_outer(F.when(~bad_status, F.col("_r.data.result"))).alias("_s"))
    pts = res.select(
        "*", F.explode_outer(F.when(F.col("_s.values").isNotNull(), F.col("_s.values"))
                             .otherwise(F.array(F.col("_s.value")))).alias("_p"))
    t_us, value = unix_text_to_us(F.col("_p")[0]), F.col("_p")[1].try_cast("double")
    pair_ok = F.when(F.size("_p") == 2, t_us.isNotNull() & value.isNotNull()).otherwise(False)
    labels = F.col("_s.metric")
    inst = F.coalesce(F.nullif(F.element_at(labels, F.lit("instance")), F.lit("")),
                      F.element_at(labels, F.lit("job")))
    return pts.select(
        *[c for c in text_df.columns if c != col],
        F.element_at(labels, F.lit("__name__")).alias("metric"),
        F.map_filter(labels, lambda k, v: k != "__name__").alias("labels"),
        inst.alias("instance"),
        F.when(pair_ok, t_us).alias("t_us"),
        F.when(pair_ok, value).alias("value"),
        F.coalesce(F.col("_err"), F.when(F.col("_s").isNotNull() & ~pair_ok,
                                         F.lit("invalid point"))).alias("error"))


# ---------------------------------------------------------------- text exposition

_LINE_RE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?[0-9]+))?\s*$"
_LABEL_RE = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def src_exposition(text_df: DataFrame, line: str = "value", ts: str = "t_us", instance: str = "instance",
                   job: str | Column = "job") -> DataFrame:
    """Scraped text exposition -> samples. Comment (``#``) and blank lines are skipped, and so
    are lines without a number or with a label given twice. The scrape target's
    ``instance`` and ``job`` win; a line's own label of that name is kept as
    ``exported_<name>``. A sample's own timestamp (ms) wins over the scrape time."""
    t = text_df.filter(~F.trim(F.col(line)).startswith("#") & (F.trim(F.col(line)) != ""))
    name = F.regexp_extract(line, _LINE_RE, 1)
    body = F.regexp_extract(line, _LINE_RE, 2)
    own = F.regexp_extract_all(body, F.lit(_LABEL_RE), 1)
    keys = F.transform(own, lambda k: F.when(k.isin("instance", "job"), F.concat(F.lit("exported_"), k)).otherwise(k))
    vals = F.transform(F.regexp_extract_all(body, F.lit(_LABEL_RE), 2),
                       lambda v: F.regexp_replace(F.regexp_replace(v, r'\\"', '"'), r"\\\\", r"\\"))
    own_ts = F.regexp_extract(line, _LINE_RE, 4).try_cast("bigint")
    value = F.regexp_extract(line, _LINE_RE, 3).try_cast("double")
    t = t.filter((F.size(F.array_distinct(keys)) == F.size(keys)) & value.isNotNull())
    jobc = job if isinstance(job, Column) else F.col(job)
    out = t.select(
        name.alias("metric"),
        F.map_concat(F.map_from_arrays(keys, vals),
                     F.create_map(F.lit("instance"), F.col(instance), F.lit("job"), jobc)).alias("labels"),
        F.col(instance).alias("instance"),
        F.coalesce(own_ts * 1000, F.col(ts)).alias("t_us"), value.alias("value"))
    return out.filter(F.col("metric") != "").withColumn("series", series_key("metric", "labels"))


# ---------------------------------------------------------------- webhook envelopes / alert events

ALERT_STRUCT = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("annotations", T.MapType(T.StringType(), T.StringType())),
    T.StructField("startsAt", T.StringType()),
    T.StructField("endsAt", T.StringType()),
    T.StructField("generatorURL", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
])
ENVELOPE_SCHEMA = T.StructType([
    T.StructField("receiver", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("alerts", T.ArrayType(ALERT_STRUCT)),
    T.StructField("groupLabels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("commonLabels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("commonAnnotations", T.MapType(T.StringType(), T.StringType())),
    T.StructField("externalURL", T.StringType()),
])
EVENT_SCHEMA = T.StructType([T.StructField("type", T.StringType())] + ALERT_STRUCT.fields
                            + [T.StructField("receivedAt", T.StringType())])
ZERO_TIME = "0001-01-01T00:00:00Z"


RFC3339_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def rfc3339_to_us(c: Column) -> Column:
    """RFC3339(Nano) text -> micro-seconds; the zero time, blanks and any other text are NULL."""
    return F.when(c.rlike(RFC3339_RE) & ~c.startswith("0001-01-01"), F.unix_micros(c.try_cast("timestamp")))


def bad_time(c: Column) -> Column:
    """Text that is there but is not an RFC3339 time (the zero time is one)."""
    return F.coalesce((c != "") & ~c.startswith("0001-01-01") & rfc3339_to_us(c).isNull(), F.lit(False))


def us_to_rfc3339(c: Column) -> Column:
    """Micro-seconds -> RFC3339 text with micro-seconds (NULL -> the zero time)."""
    return F.coalesce(F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit(ZERO_TIME))


def _alert_cols(a: str) -> list[Column]:
    return [F.col(f"{a}.fingerprint").alias("fingerprint"), F.col(f"{a}.status").alias("status"),
            F.col(f"{a}.labels").alias("labels"), F.col(f"{a}.annotations").alias("annotations"),
            rfc3339_to_us(F.col(f"{a}.startsAt")).alias("starts_us"),
            rfc3339_to_us(F.col(f"{a}.endsAt")).alias("ends_us"),
            F.nullif(F.col(f"{a}.generatorURL"), F.lit("")).alias("generator_url")]


def src_webhook(text_df: DataFrame, body: str = "body", received: str = "received_us") -> DataFrame:
    """Webhook envelopes -> alert records. Blank-fingerprint alerts are skipped; any other
    alert with an unsupported status, or any alert with a time that is none, rejects the
    WHOLE envelope (checked with a higher-order ``exists`` before exploding)."""
    e = text_df.select("*", F.from_json(F.col(body), ENVELOPE_SCHEMA).alias("_e"))

    def bad(a):
        status_ok = F.coalesce(a["status"].isin("firing", "resolved"), F.lit(False))
        return ((F.coalesce(a["fingerprint"], F.lit("")) != "") & ~status_ok) | bad_time(a["startsAt"]) | bad_time(a["endsAt"])

    ok = e.filter(F.col("_e").isNotNull() & ~F.exists(F.coalesce("_e.alerts", F.array()), bad))
    x = ok.select(F.col(received).alias("received_us"), F.posexplode("_e.alerts").alias("pos", "_a"))
    return (x.filter(F.coalesce(F.col("_a.fingerprint"), F.lit("")) != "")
            .select(*_alert_cols("_a"), "received_us", "pos"))


_TEXT_FIELDS = ["type", "status", "startsAt", "endsAt", "generatorURL", "fingerprint", "receivedAt"]
_MAP_FIELDS = ["labels", "annotations"]


def _well_typed(v: Column) -> Column:
    """Whether a JSON variant decodes as an alert event: text fields are text, maps hold text only."""
    ok = F.lit(True)
    for f in _TEXT_FIELDS:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
        ok = ok & F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
    for f in _MAP_FIELDS:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
        values = F.map_values(F.try_variant_get(v, f"$.{f}", "map<string,variant>"))
        text = F.forall(values, lambda x: F.coalesce(F.schema_of_variant(x).isin("STRING", "VOID"), F.lit(True)))
        ok = ok & F.coalesce((kind == "VOID") | (kind.startswith("OBJECT") & text), F.lit(True))
    return ok


def parse_alert_events(kv: DataFrame, value: str = "value") -> DataFrame:
    """Alert-event messages -> alert columns + ``outcome``: ``invalid_json`` for values that do
    not decode as an event (no JSON object, a field of another type, a time that is none),
    ``permanent_error`` for a missing fingerprint or bad status, ``processed`` otherwise.
    The message key is not looked at. ``type`` defaults to ``alert``."""
    p = kv.withColumn("_v", F.try_parse_json(F.col(value)))
    is_object = F.coalesce(F.col("_v").isNotNull() & F.regexp_like(F.col(value), F.lit(r"^\s*\{")), F.lit(False))
    p = p.withColumn("_json", F.when(is_object, _well_typed(F.col("_v"))).otherwise(F.lit(False)))
    p = p.withColumn("_m", F.from_json(F.when(F.col("_json"), F.col(value)), EVENT_SCHEMA))
    times = bad_time(F.col("_m.startsAt")) | bad_time(F.col("_m.endsAt")) | bad_time(F.col("_m.receivedAt"))
    decoded = F.col("_json") & ~times
    outcome = (F.when(~decoded, "invalid_json")
               .when((F.coalesce(F.col("_m.fingerprint"), F.lit("")) == "")
                     | ~F.coalesce(F.col("_m.status").isin("firing", "resolved"), F.lit(False)), "permanent_error")
               .otherwise("processed"))
    keep = [c for c in kv.columns if c not in (value,)]

    def m(c: Column) -> Column:
        return F.when(decoded, c)

    return p.select(
        *keep, F.coalesce(F.col("_m.type"), F.lit("alert")).alias("type"), m(F.col("_m.fingerprint")).alias("fingerprint"),
        m(F.col("_m.status")).alias("status"), m(F.col("_m.labels")).alias("labels"),
        m(F.col("_m.annotations")).alias("annotations"), m(rfc3339_to_us(F.col("_m.startsAt"))).alias("starts_us"),
        m(rfc3339_to_us(F.col("_m.endsAt"))).alias("ends_us"),
        m(F.nullif(F.col("_m.generatorURL"), F.lit(""))).alias("generator_url"),
        m(rfc3339_to_us(F.col("_m.receivedAt"))).alias("received_us"), outcome.alias("outcome"))


def kafka_available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:  # noqa: BLE001
        return False


def src_alert_events(spark: SparkSession, path: str | None = None, kafka: dict | None = None,
                     streaming: bool = False, topic: str = "alert-events") -> DataFrame:
    """The alert-event topic: Kafka when the connector is on the class path and options are
    given (``startingOffsets=earliest``), else files: a partitioned topic folder (see ``topic``,
    read by offsets) if ``path`` holds one, JSON lines (one message a line) if not."""
    if kafka and kafka_available(spark):
        rd = spark.readStream if streaming else spark.read
        opts = {"subscribe": topic, "startingOffsets": "earliest", **kafka}
        kv = rd.format("kafka").options(**opts).load().select(
            F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
            "partition", "offset")
    else:
        if path is None:
            raise ValueError("need a path (or kafka options with the connector present)")
        if topics.segments(path):
            return parse_alert_events(topics.read_topic(spark, path, streaming))
        rd = spark.readStream.schema("value string") if streaming else spark.read
        kv = rd.text(path).withColumn("key", F.lit(None).cast("string"))
    return parse_alert_events(kv)


# ---------------------------------------------------------------- container logs

LOG_FIELDS = ["ts", "level", "msg", "service", "instance", "trace_id", "span_id", "request_id", "method", "path",
              "status", "latency_ms", "client_ip", "error", "collector", "caller", "stacktrace"]
INNER_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in LOG_FIELDS])
DOCKER_SCHEMA = T.StructType([T.StructField("log", T.StringType()), T.StructField("stream", T.StringType()),
                              T.StructField("time", T.StringType())])
_CRI_RE = r"^(\S+) (stdout|stderr) ([FP]) ?(.*)$"


def _parse_inner(df: DataFrame, log_text: Column) -> DataFrame:
    """Parse the inner application JSON ONCE into ``_m`` (map of raw field text; NULL when the
    line is not a JSON object); a separate projection so the parse is never duplicated."""
    txt = F.regexp_replace(log_text, r"\n$", "")
    m = F.from_json(F.when(F.trim(txt).startswith("{"), txt), T.MapType(T.StringType(), T.StringType()))
    return df.withColumn("_txt", txt).withColumn("_m", m)


def _inner_cols() -> list[Column]:
    """Typed log columns from ``_m``; non-JSON lines keep ``raw``; unknown keys go to ``extras``."""
    m = F.col("_m")
    cols = [F.element_at(m, F.lit(f)).alias(f) for f in LOG_FIELDS if f not in ("ts", "status", "latency_ms")]
    return cols + [
        rfc3339_to_us(F.element_at(m, F.lit("ts"))).alias("t_us"),
        F.element_at(m, F.lit("status")).try_cast("int").alias("status"),
        F.element_at(m, F.lit("latency_ms")).try_cast("double").alias("latency_ms"),
        F.map_filter(m, lambda k, v: ~k.isin(*LOG_FIELDS)).alias("extras"),
        F.when(m.isNull(), F.col("_txt")).alias("raw"),
    ]


def src_container_logs(text_df: DataFrame, line: str = "value") -> DataFrame:
    """Docker json-file lines ``{log, stream, time}``: the inner ``log`` is parsed as the
    app's JSON record (outer stream/time kept); non-JSON inner lines keep ``raw`` and take
    the outer time."""
    o = text_df.select("*", F.from_json(F.col(line), DOCKER_SCHEMA).alias("_o"))
    o = _parse_inner(o, F.col("_o.log"))
    keep = [c for c in text_df.columns if c != line]
    r = o.select(*keep, F.col("_o.stream").alias("stream"), rfc3339_to_us(F.col("_o.time")).alias("time_us"),
                 *_inner_cols())
    return r.withColumn("t_us", F.coalesce("t_us", "time_us"))


#: Lines of one file that are assembled in one task.
CRI_LINES = 1_000_000


def src_cri_logs(text_df: DataFrame, line: str = "value", file: str = "file", order: str = "line_no",
                 lines: int = CRI_LINES, delay: str = "10 minutes") -> DataFrame:
    """CRI lines ``time stream tag log``: partial (``P``) pieces are joined with the next
    full (``F``) line of the same file, then parsed like docker lines. The piece-to-line
    assignment is a running count of ``F`` tags per file (keyed scan in stretches of
    ``lines`` lines). On a stream the open pieces of a file are state, and ``delay`` is the
    watermark's; pieces that nothing closes are dropped, as in the batch form."""
    from vigil.operators.scans import keyed_running_sum
    t = text_df.select("*", *[F.regexp_extract(line, _CRI_RE, i).alias(n)
                              for i, n in ((1, "_time"), (2, "_stream"), (3, "_tag"), (4, "_log"))])
    t = t.filter(F.col("_tag") != "")
    if text_df.isStreaming:
        from vigil.streaming.lines import assembled_lines

        pieces = t.select(F.col(file).alias("file"), F.col(order).alias("line_no"), F.col("_tag").alias("tag"), F.col("_stream").alias("stream"),
                          rfc3339_to_us(F.col("_time")).alias("time_us"), F.col("_log").alias("log"))
        g = _parse_inner(assembled_lines(pieces, delay=delay).filter("closed"), F.col("text"))
        r = g.select(F.col("file").alias(file), F.col("line_no").alias(order), "stream", "time_us", *_inner_cols())
        return r.withColumn("t_us", F.coalesce("t_us", "time_us"))
    t = t.withColumn("_t", rfc3339_to_us(F.col("_time"))).withColumn("_f", (F.col("_tag") == "F").cast("bigint"))
    t = keyed_running_sum(t, [file], order, order, "_f", "_nf", bucket_us=lines)
    # a piece belongs to the F line that closes it: pieces before the k-th F have _nf = k-1
    t = t.withColumn("_grp", F.when(F.col("_tag") == "F", F.col("_nf") - 1).otherwise(F.col("_nf")))
    g = t.groupBy(file, "_grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_log"))), lambda s: s["_log"]), "")
        .alias("_msg"),
        F.max_by(F.struct("_time", "_stream", "_t", order), F.col(order)).alias("_last"),
        F.max("_f").alias("_complete"))
    g = _parse_inner(g.filter(F.col("_complete") == 1), F.col("_msg"))
    r = g.select(file, F.col(f"_last.{order}").alias(order), F.col("_last._stream").alias("stream"),
                 F.col("_last._t").alias("time_us"), *_inner_cols())
    return r.withColumn("t_us", F.coalesce("t_us", "time_us"))


_K8S_PATH_RE = r"([^/]+)_([^_/]+)_(.+)-([0-9a-f]{64})\.log$"


def log_k8s_enrich(L: DataFrame, pods: DataFrame, path: str = "file") -> DataFrame:
    """Kubernetes metadata from the container log file name
    (``<pod>_<namespace>_<container>-<id>.log``) plus host/labels from the pods table
    (left join; Spark broadcasts it when its statistics are under the threshold)."""
    k = L.withColumn("_pod", F.regexp_extract(path, _K8S_PATH_RE, 1)) \
         .withColumn("_ns", F.regexp_extract(path, _K8S_PATH_RE, 2)) \
         .withColumn("_ct", F.regexp_extract(path, _K8S_PATH_RE, 3))
    p = pods.select(F.col("pod_name").alias("_pod"), F.col("namespace_name").alias("_ns"),
                    F.col("host").alias("_host"), F.col("labels").alias("_plabels"))
    j = k.join(p, ["_pod", "_ns"], "left")
    kube = F.struct(F.nullif(F.col("_pod"), F.lit("")).alias("pod_name"), F.nullif(F.col("_ns"), F.lit("")).alias("namespace_name"),
                    F.nullif(F.col("_ct"), F.lit("")).alias("container_name"), F.col("_host").alias("host"),
                    F.col("_plabels").alias("labels"))
    return j.withColumn("kubernetes", kube).drop("_pod", "_ns", "_ct", "_host", "_plabels")


def log_flatten_dots(L: DataFrame, col: str = "extras") -> DataFrame:
    """Dots in dynamic field names become underscores."""
    return L.withColumn(col, F.transform_keys(col, lambda k, v: F.replace(k, F.lit("."), F.lit("_"))))
