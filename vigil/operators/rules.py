"""Threshold alert rules: screening, evaluation on the tick grid, the ``for`` state machine,
the synthetic ALERTS series and firing/resolved transitions.

Rules are structured rows (``metric, matchers MAP, fn, window_s, agg, by, cmp, threshold,
for_ms, severity, summary, description, enabled``) rather than expression text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.labels import label_text, trim_space
from vigil.functions.timeutil import dur_us
from vigil.operators import series as sr

# Fixed values of the rule screen.
FORBIDDEN_TERMS = ["admin_api", "scrape_interval", "scrape_duration"]
SEVERITIES = ["critical", "warning", "info"]
NAME_MAX = 128
EXPR_MAX = 2048
SUMMARY_MAX = 512
DEFAULT_DURATION = "2m"
DEFAULT_SEVERITY = "warning"
EVAL_INTERVAL = "15s"
# Windows (seconds) that rate rules may use; others are refused by an error at run time.
RATE_WINDOWS_S = (60, 300)

DURATION_RE = r"^(?:[0-9]*[1-9][0-9]*(?:ms|[smhdwy]))+$"
SUBQUERY_RE = r"\[[^\]]*:[^\]]*\]"


def rules_enabled(rules: DataFrame) -> DataFrame:
    return rules.filter(F.coalesce(F.col("enabled"), F.lit(True))).orderBy("id")


def duration_valid(c: Column) -> Column:
    """Positive duration: number+unit groups (ms s m h d w y), no zero group (``1h0m`` is bad)."""
    return F.coalesce(c.rlike(DURATION_RE), F.lit(False))


def duration_ms(c: Column) -> Column:
    """Milli-seconds of a valid duration text (sum over its groups)."""
    groups = F.regexp_extract_all(c, F.lit(r"([0-9]+(?:ms|[smhdwy]))"), 1)
    unit_ms = F.create_map(*[x for k, v in {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000,
                                             "w": 604_800_000, "y": 31_536_000_000}.items()
                             for x in (F.lit(k), F.lit(v).cast("bigint"))])
    return F.aggregate(groups, F.lit(0).cast("bigint"),
                       lambda acc, g: acc + F.regexp_extract(g, r"^([0-9]+)", 1).cast("bigint")
                       * F.element_at(unit_ms, F.regexp_extract(g, r"^[0-9]+(ms|[smhdwy])$", 1)))


def rules_validate(rules: DataFrame) -> DataFrame:
    """Normalise (trim, defaults: duration 2m, severity warning, enabled true) and give the
    first failing reason (NULL when valid). Lengths are bytes."""
    name = trim_space(F.coalesce("name", F.lit("")))
    expr = trim_space(F.coalesce("expr", F.lit("")))
    dur = trim_space(F.coalesce("duration", F.lit("")))
    dur = F.when(dur == "", F.lit(DEFAULT_DURATION)).otherwise(dur)
    sev = trim_space(F.coalesce("severity", F.lit("")))
    sev = F.when(sev == "", F.lit(DEFAULT_SEVERITY)).otherwise(sev)
    summary = trim_space(F.coalesce("summary", F.lit("")))
    r = rules.select(
        "id", name.alias("name"), expr.alias("expr"), dur.alias("duration"), sev.alias("severity"),
        summary.alias("summary"), trim_space(F.coalesce("description", F.lit(""))).alias("description"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"))
    lower = F.lower("expr")
    forbidden = F.lit(False)
    for t in FORBIDDEN_TERMS:
        forbidden = forbidden | lower.contains(t)
    reason = (
        F.when((F.octet_length("name") == 0) | (F.octet_length("name") > NAME_MAX), "name must be 1-128 characters")
        .when(F.octet_length("expr") == 0, "expr is required")
        .when(F.octet_length("expr") > EXPR_MAX, "expr too long")
        .when(forbidden, "expr contains forbidden reference")
        .when(F.col("expr").rlike(SUBQUERY_RE), "expr subquery is not allowed")
        .when(~duration_valid(F.col("duration")), "duration must be a positive prometheus duration")
        .when(~F.col("severity").isin(*SEVERITIES), "invalid severity")
        .when(F.octet_length("summary") > SUMMARY_MAX, "summary must be at most 512 characters"))
    return r.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def _matches(labels: Column, matchers: Column) -> Column:
    return F.forall(F.map_entries(matchers), lambda e: F.coalesce(F.element_at(labels, e["key"]), F.lit("")) == e["value"])


def _cmp(value: Column, op: Column, thr: Column) -> Column:
    out = F.when(F.isnan(value) | F.isnan(thr), op == "!=")
    for name in (">", ">=", "<", "<=", "==", "!="):
        out = out.when(op == name, sr.compare_col(value, name, thr))
    return out.otherwise(F.lit(False))


def rule_eval(S: DataFrame, rules: DataFrame, start_us: int, end_us: int, tick: str | int = EVAL_INTERVAL,
              lookback: str | int = "5m", windows: tuple[int, ...] = RATE_WINDOWS_S,
              vectors: DataFrame | None = None) -> DataFrame:
    """Evaluate every enabled rule at every tick of ``[start, end]``.

    One grid lookup over the union of the rules' metrics, then a join of the rule table on
    ``metric`` (Spark picks its kind by size), label matchers as a higher-order ``forall``,
    optional ``rate`` over one of ``windows`` and aggregation ``by`` labels, which stay real
    labels, and the comparison. ``vectors`` are derived vectors already on the grid (``metric,
    series, labels, eval_us, value``, such as error ratios); rules name them as their metric. -> rule_id, rule, series, labels, eval_us, value, is_true.
    """
    r = rules.filter(F.coalesce(F.col("enabled"), F.lit(True))).select(
        F.col("id").alias("rule_id"), F.col("name").alias("rule"), F.col("metric").alias("_rm"),
        F.coalesce("matchers", F.create_map().cast("map<string,string>")).alias("_mt"),
        F.coalesce("fn", F.lit("none")).alias("_fn"), F.coalesce("window_s", F.lit(300)).alias("_win"),
        F.coalesce("agg", F.lit("none")).alias("_agg"),
        F.coalesce("by", F.array().cast("array<string>")).alias("_by"), F.col("cmp").alias("_cmp"),
        F.col("threshold").alias("_thr"))
    bad_window = F.raise_error(F.lit("rule_eval: a rate window that is not among the windows of the call"))
    r = r.withColumn("_win", F.when((F.col("_fn") != "rate") | F.col("_win").isin(*windows), F.col("_win")).otherwise(bad_window.cast("bigint")))
    metrics = r.select("_rm").distinct()
    sel = S.join(metrics, S["metric"] == metrics["_rm"], "left_semi")
    parts = [sr.range_vector_grid(sel, start_us, end_us, tick, lookback)
             .join(r.filter(F.col("_fn") == "none"), F.col("metric") == F.col("_rm"))]
    if vectors is not None:
        derived = vectors.select("metric", F.element_at("labels", F.lit("instance")).alias("instance"), "series", "labels", "eval_us", "value")
        parts.append(derived.join(r.filter(F.col("_fn") == "none"), F.col("metric") == F.col("_rm")))
    for w in windows:
        rr = r.filter((F.col("_fn") == "rate") & (F.col("_win") == w))
        m = rr.select("_rm").distinct()
        rs = sr.rate(S.join(m, S["metric"] == m["_rm"], "left_semi"), start_us, end_us, tick, int(w) * 1_000_000)
        parts.append(rs.join(rr, F.col("metric") == F.col("_rm")))
    v = parts[0]
    for p in parts[1:]:
        v = v.unionByName(p, allowMissingColumns=True)
    v = v.filter(_matches(F.col("labels"), F.col("_mt")))
    # aggregation "by" labels (agg = none keeps the series)
    gkey = F.transform("_by", lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at("labels", k), F.lit(""))))
    values = F.transform(F.array_distinct("_by"), lambda k: F.coalesce(F.element_at("labels", k), F.lit("")))
    grouped = (v.filter(F.col("_agg") != "none").withColumn("_gv", values)
               .withColumn("_g", F.array_join(gkey, ","))
               .groupBy("rule_id", "rule", "_agg", "_cmp", "_thr", "_g", "_by", "_gv", "eval_us")
               .agg(F.sum("value").alias("_s"), F.avg("value").alias("_a"), sr._AGG["max"]("value").alias("_x"),
                    sr._AGG["min"]("value").alias("_n"), F.count(F.lit(1)).cast("double").alias("_c"))
               .withColumn("labels", F.map_filter(F.map_from_arrays(F.array_distinct("_by"), "_gv"), lambda k, x: x != ""))
               .withColumn("value", F.when(F.col("_agg") == "sum", F.col("_s")).when(F.col("_agg") == "avg", F.col("_a"))
                           .when(F.col("_agg") == "max", F.col("_x")).when(F.col("_agg") == "min", F.col("_n"))
                           .otherwise(F.col("_c")))
               .withColumn("series", F.concat(F.lit("{"), F.col("_g"), F.lit("}"))))
    plain = v.filter(F.col("_agg") == "none")
    cols = ["rule_id", "rule", "series", "labels", "eval_us", "value", "_cmp", "_thr"]
    out = plain.select(*cols).unionByName(grouped.select(*cols))
    return out.withColumn("is_true", _cmp(F.col("value"), F.col("_cmp"), F.col("_thr"))).drop("_cmp", "_thr")


def rule_for(evals: DataFrame, rules: DataFrame, tick: str | int = EVAL_INTERVAL) -> DataFrame:
    """The ``for`` clause: a run of consecutive true ticks (a false or missing tick breaks it)
    starts at ``active_since``; state is ``firing`` once ``tick - active_since >= for``,
    else ``pending``. Gaps-and-islands on the tick index; a (rule, series) holds at most
    one row per tick, so its window is bounded by the grid, not by the data."""
    step = dur_us(tick)
    fr = rules.select(F.col("id").alias("rule_id"), F.col("for_ms"), F.col("severity"))
    t = evals.filter("is_true").join(fr, "rule_id")
    w = Window.partitionBy("rule_id", "series").orderBy("eval_us")
    t = t.withColumn("_island", F.floor(F.col("eval_us") / F.lit(step)) - F.row_number().over(w))
    wi = Window.partitionBy("rule_id", "series", "_island")
    t = t.withColumn("active_since", F.min("eval_us").over(wi))
    state = F.when(F.col("eval_us") - F.col("active_since") >= F.col("for_ms") * 1000, "firing").otherwise("pending")
    return t.withColumn("state", state).drop("_island")


def alerts_series(states: DataFrame) -> DataFrame:
    """Synthetic ALERTS rows: alertname, alertstate, severity, series labels, tick."""
    return states.select(F.col("rule").alias("alertname"), F.col("state").alias("alertstate"), "severity",
                         "series", "labels", "eval_us", F.lit(1.0).alias("value"))


def alerts_counts(alerts: DataFrame) -> DataFrame:
    """Dashboard counts of firing ALERTS per tick: total, by severity, by (alertname, severity),
    by instance; one aggregate over the counts for each view."""
    f = alerts.filter(F.col("alertstate") == "firing").withColumn(
        "instance", F.coalesce(F.element_at("labels", F.lit("instance")), F.lit("")))
    g = (f.groupBy("eval_us", "alertname", "severity", "instance")
         .agg(F.count(F.lit(1)).alias("n")))
    total = g.groupBy("eval_us").agg(F.sum("n").alias("n")).select(F.lit("total").alias("view"), "eval_us",
                                                                   F.lit("").alias("key"), "n")
    sev = g.groupBy("eval_us", "severity").agg(F.sum("n").alias("n")).select(
        F.lit("severity").alias("view"), "eval_us", F.col("severity").alias("key"), "n")
    name = g.groupBy("eval_us", "alertname", "severity").agg(F.sum("n").alias("n")).select(
        F.lit("alertname").alias("view"), "eval_us", F.concat_ws("/", "alertname", "severity").alias("key"), "n")
    inst = g.groupBy("eval_us", "instance").agg(F.sum("n").alias("n")).select(
        F.lit("instance").alias("view"), "eval_us", F.col("instance").alias("key"), "n")
    return total.unionByName(sev).unionByName(name).unionByName(inst)


def _render(template: Column, labels: Column, value: Column) -> Column:
    """``{{ $labels.x }}`` and ``{{ $value }}`` substitution (whole numbers without ``.0``)."""
    vtxt = F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(value.cast("string"))
    out = F.regexp_replace(template, r"\{\{\s*\$value\s*\}\}", vtxt)
    keys = F.map_keys(labels)
    return F.aggregate(keys, out, lambda acc, k: F.replace(acc, F.concat(F.lit("{{ $labels."), k, F.lit(" }}")),
                                                           F.element_at(labels, k)))


def rule_transitions(states: DataFrame, rules: DataFrame, end_us: int, tick: str | int = EVAL_INTERVAL) -> DataFrame:
    """Firing and resolved edges as alert records.

    Each run that reaches ``firing`` yields a firing record at its first firing tick
    (startsAt = that tick) and, when the run ends before ``end``, a resolved record at the
    first tick after it (endsAt = that tick). Labels = series labels + alertname +
    severity; annotations rendered from the rule templates; fingerprint over labels.
    """
    step = dur_us(tick)
    runs = (states.groupBy("rule_id", "rule", "series", "active_since")
            .agg(F.min(F.when(F.col("state") == "firing", F.col("eval_us"))).alias("fired_us"),
                 F.max("eval_us").alias("last_us"),
                 F.max_by(F.struct("value", "labels"), "eval_us").alias("_v"))
            .filter(F.col("fired_us").isNotNull()))
    rl = rules.select(F.col("id").alias("rule_id"), "severity", "summary", "description")
    runs = runs.join(rl, "rule_id")
    labels = F.map_concat(F.map_filter("_v.labels", lambda k, v: ~k.isin("alertname", "severity")),
                          F.create_map(F.lit("alertname"), F.col("rule"), F.lit("severity"), F.col("severity")))
    runs = runs.withColumn("labels", labels)
    ann = F.create_map(F.lit("summary"), _render(F.col("summary"), F.col("labels"), F.col("_v.value")),
                       F.lit("description"), _render(F.col("description"), F.col("labels"), F.col("_v.value")))
    base = runs.select("rule_id", "labels", ann.alias("annotations"), F.md5(label_text("labels")).alias("fingerprint"),
                       F.col("fired_us").alias("starts_us"), "last_us")
    firing = base.select("fingerprint", F.lit("firing").alias("status"), "labels", "annotations", "starts_us",
                         F.lit(None).cast("bigint").alias("ends_us"), F.col("starts_us").alias("event_us"))
    resolved = (base.filter(F.col("last_us") + F.lit(step) <= F.lit(end_us))
                .select("fingerprint", F.lit("resolved").alias("status"), "labels", "annotations", "starts_us",
                        (F.col("last_us") + F.lit(step)).alias("ends_us"),
                        (F.col("last_us") + F.lit(step)).alias("event_us")))
    return firing.unionByName(resolved)
