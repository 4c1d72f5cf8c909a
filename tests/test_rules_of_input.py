"""Hand-made rows for bad input, NaN, screens and skew, where oracles on derived tables say little."""

import math

import pytest
from pyspark.sql import functions as F

from vigil.functions.labels import trim_space
from vigil.functions.urls import url_reason
from vigil.operators import hosts as ho
from vigil.operators import logs as lg
from vigil.operators import rules as ru
from vigil.operators import scans, series as sr
from vigil.plans import catalog
from vigil.sources import parsers as ps

NAN = float("nan")


def test_every_core_query_has_an_oracle():
    assert len(catalog.QUERIES) >= 100 and set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize(("text", "us"), [
    ("2024-01-01T00:00:00Z", 1_704_067_200_000_000), ("2024-01-01T00:00:00.5+01:00", 1_704_063_600_500_000), ("12:00", None), ("2024-01-01", None),
    ("not-a-time", None), ("", None), (None, None), ("0001-01-01T00:00:00Z", None), ("2024-13-01T00:00:00Z", None)])
def test_times(spark, text, us):
    r = spark.createDataFrame([(text,)], "t string").select(ps.rfc3339_to_us(F.col("t")).alias("us"), ps.bad_time(F.col("t")).alias("bad")).first()
    assert r.us == us and r.bad == (us is None and text not in (None, "", "0001-01-01T00:00:00Z"))


def outcome(spark, value, key="k"):
    return ps.parse_alert_events(spark.createDataFrame([(key, value)], "key string, value string")).first()


@pytest.mark.parametrize(("value", "want"), [
    ('{"fingerprint":"f","status":"firing","labels":{"a":"b"}}', "processed"), ('{"fingerprint":" ","status":"firing"}', "processed"),
    ('{"status":"firing"}', "permanent_error"), ('{"fingerprint":"f","status":"odd"}', "permanent_error"), ('{"fingerprint":"f"', "invalid_json"),
    ('[1]', "invalid_json"), (None, "invalid_json"), ('{"fingerprint":"f","status":"firing","labels":"x"}', "invalid_json"),
    ('{"fingerprint":"f","status":"firing","labels":{"a":1}}', "invalid_json"), ('{"fingerprint":5,"status":"firing"}', "invalid_json"),
    ('{"fingerprint":"f","status":"firing","startsAt":"12:00"}', "invalid_json"), ('{"fingerprint":"f","status":"firing","labels":null}', "processed")])
def test_alert_event_outcomes(spark, value, want):
    assert outcome(spark, value).outcome == want


def test_query_response_with_bad_points(spark):
    body = '{"status":"success","data":{"resultType":"matrix","result":[{"metric":{"__name__":"m","job":"j"},"values":[[1,"2"],["x","3"],[4,"y"],[5]]}]}}'
    rows = ps.src_query_response(spark.createDataFrame([(body,), ("{",)], "body string")).collect()
    assert sorted((r.t_us or 0, r.value or 0.0, r.error or "") for r in rows if r.metric) == [(0, 0.0, "invalid point")] * 3 + [(1_000_000, 2.0, "")]
    assert len(rows) == 5


def test_exposition_with_bad_lines(spark):
    lines = ['a{job="mine",x="1"} 5', "a notanumber", 'a{x="1",x="2"} 5', "# a 7", "   ", "b +Inf 12"]
    rows = ps.src_exposition(spark.createDataFrame([(x, 7, "h", "probe") for x in lines], "value string, t_us long, instance string, job string")).collect()
    assert [(r.metric, r.value, r.t_us) for r in rows] == [("a", 5.0, 7), ("b", math.inf, 12000)]
    assert rows[0].labels == {"exported_job": "mine", "x": "1", "job": "probe", "instance": "h"}


def test_container_log_with_bad_fields(spark):
    line = '{"log":"{\\"ts\\":\\"12:00\\",\\"status\\":\\"abc\\",\\"latency_ms\\":\\"x\\",\\"msg\\":\\"m\\"}\\n","stream":"stdout","time":"2024-01-01T00:00:00Z"}'
    r = ps.src_container_logs(spark.createDataFrame([(line,)], "value string")).first()
    assert (r.msg, r.status, r.latency_ms, r.t_us) == ("m", None, None, 1_704_067_200_000_000)


def test_cri_lines_over_many_stretches(spark):
    rows = [(f, i, f"2024-01-01T00:00:00Z stdout {'P' if i % 3 else 'F'} {i};") for f in ("a", "b") for i in range(1, 301)]
    frame = spark.createDataFrame(rows, "file string, line_no long, value string")
    whole, split = ([sorted((r.file, r.line_no, r.raw) for r in ps.src_cri_logs(frame, lines=n).collect()) for n in (10_000, 7)])
    assert whole == split and len(whole) == 200 and whole[1] == ("a", 6, "4;5;6;")


def vector(spark, rows):
    return spark.createDataFrame([(i, s, float(v)) for i, s, v in rows], "eval_us long, series string, value double").withColumn("g", F.lit("g"))


def test_nan_rules(spark):
    v = vector(spark, [(1, "a", NAN), (1, "b", 5), (1, "c", 7), (2, "a", NAN)])
    assert sorted(r.value for r in sr.compare_filter(v, ">", 4).collect()) == [5.0, 7.0]
    assert len(sr.compare_filter(v, "!=", 5).collect()) == 3
    top = {(r.eval_us, r.series) for r in sr.topk(v, 2).collect()}
    assert top == {(1, "b"), (1, "c"), (2, "a")}
    for fn, want in (("max", 7.0), ("min", 5.0)):
        got = {r.eval_us: r.value for r in sr.agg_by(v, fn, ["g"]).collect()}
        assert got[1] == want and math.isnan(got[2])
    d = sr.vector_div(vector(spark, [(1, "a", NAN), (2, "a", 1)]), vector(spark, [(1, "x", 0), (2, "x", 0)]), ["g"])
    got = {r.eval_us: r.value for r in d.collect()}
    assert math.isnan(got[1]) and got[2] == math.inf


def test_vector_div_refuses_several_series_in_a_group(spark):
    v = vector(spark, [(1, "a", 1), (1, "b", 2)])
    with pytest.raises(Exception, match="share a match group"):
        sr.vector_div(v, v, ["g"]).collect()


def test_hot_host_bands_ignore_nan(spark):
    h = spark.createDataFrame([("a", NAN, 90.0), ("b", 85.0, NAN)], "instance string, cpu double, memory double")
    assert {r.instance: r.risk for r in ho.host_risk(h).collect()} == {"a": "memory", "b": "cpu"}


@pytest.mark.parametrize(("text", "want"), [
    ('{"password":"x1","user":"u"}', '{"password":"***","user":"u"}'), ("Cookie: a=1; b=2", "Cookie: ***"),
    ("Authorization: Digest username=q, response=w", "Authorization: Digest ***"), ('{"authorization":"Basic abc"}', '{"authorization":"Basic ***"}'),
    ("postgres://u:p@h/d", "postgres://u:***@h/d"), ("api_key: 5 done", "api_key: *** done"), ("nothing here", "nothing here")])
def test_redact(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(lg.redact(F.col("t")).alias("r")).first().r == want


def test_search_finds_long_paths(spark):
    cols = "t_us long, request_id string, path string, msg string"
    L = spark.createDataFrame([(1, "r", "p" * 300, "m" * 300)], cols)
    assert lg.log_search(L, {"path": ["p" * 300]}).count() == 1 and lg.log_search(L, {"msg": ["m" * 300]}).count() == 0
    assert lg.log_search(L, query=("or", ("is", "path", "x"), ("like", "msg", "*q*", "m*"))).count() == 1
    assert lg.log_search(L, query=("not", ("exists", "msg"))).count() == 0


@pytest.mark.parametrize(("url", "reason"), [
    ("http://[::ffff:127.0.0.1]/", "url host is restricted"), ("http://[0:0:0:0:0:0:0:1]/", "url host is restricted"), ("http://[::]/", "url host is restricted"),
    ("http://[::ffff:7f00:1]/", "url host is restricted"), ("http://[fe80::1]/", "url host is restricted"), ("http://[2001:db8::1]/", None),
    ("http://010.0.0.1/", None), ("http://256.0.0.1/", None), ("http://10.1.2.3/", "url host is restricted"), ("http://a b/", "invalid url"),
    ("ftp://x/", "url scheme must be http or https"), ("http://[64:ff9b::8.8.8.8]/", None)])
def test_urls(spark, url, reason):
    assert spark.createDataFrame([(url,)], "u string").select(url_reason(F.col("u")).alias("r")).first().r == reason


def test_group_requests(spark):
    rows = [(1, 1, " a ", "\th1\n"), (2, 1, "a", "h1"), (3, 2, "n" * 129, "h"), (4, 3, "ok", "m" * 256), (5, 4, "ok", "x"), (6, 4, "ok", " ")]
    got = {(r.id, r.instance[:3], r.reason) for r in ho.group_normalise(spark.createDataFrame(rows, "id long, group_id long, name string, instance string")).collect()}
    member = "instance must be 1-256 characters"
    assert got == {(1, "h1", None), (3, "h", "name must be 1-128 characters"), (4, "mmm", None), (5, "x", member), (6, "", member)}


def test_trim_space(spark):
    assert spark.createDataFrame([("\t  a b  \n",)], "t string").select(trim_space("t").alias("t")).first().t == "a b"


def test_grouped_rule_keeps_real_labels(spark):
    S = spark.createDataFrame([("m", {"instance": "h1", "x": str(i)}, "h1", f"m{{{i}}}", 1_000_000 * 15, float(i)) for i in range(3)],
                              "metric string, labels map<string,string>, instance string, series string, t_us long, value double")
    rules = spark.createDataFrame([(1, "R", "m", {}, "none", 0, "sum", ["instance"], ">", 1.0, 0, "warning", "on {{ $labels.instance }}: {{ $value }}", "", True)],
                                  "id long, name string, metric string, matchers map<string,string>, fn string, window_s long, agg string, by array<string>, cmp string, "
                                  "threshold double, for_ms long, severity string, summary string, description string, enabled boolean")
    ev = ru.rule_eval(S, rules, 15_000_000, 30_000_000).filter("eval_us = 15000000")
    r = ev.first()
    assert (r.labels, r.value, r.is_true) == ({"instance": "h1"}, 3.0, True)
    t = ru.rule_transitions(ru.rule_for(ev, rules), rules, 15_000_000).first()
    assert t.annotations["summary"] == "on h1: 3"


def test_ttl_with_short_long_and_repeated_ids(spark):
    rows = [("a", 0, 1), ("a", 5, 2), ("b", 0, 3), ("b", 8, 4), ("b", 11, 5), ("b", 30, 6), ("b", 30, 6)]
    got = scans.greedy_ttl_accept(spark.createDataFrame(rows, "k string, t long, id long"), ["k"], "t", "id", 10).collect()
    assert sorted((r.id, r.accepted) for r in got) == [(1, True), (2, False), (3, True), (4, False), (5, True), (6, True), (6, True)]


def test_display_number(spark):
    v = spark.createDataFrame([(5.0,), (5.25,), (None,)], "value double")
    assert [r.text for r in sr.display_units(v, "number").collect()] == ["5", "5.3", "--"]
