"""Samples stored by series id."""

from vigil.functions.labels import series_key
from vigil.operators.series import select_series
from vigil.sources import series_store as st


def test_matchers_run_on_series_and_shards_are_pruned(spark, tmp_path):
    rows = [(m, {"n": str(n), "kind": "even" if n % 2 == 0 else "odd"}, f"h{n % 3}", t, float(t)) for m in ("a", "b") for n in range(12) for t in range(50)]
    s = spark.createDataFrame(rows, "metric string, labels map<string,string>, instance string, t_us long, value double").withColumn("series", series_key("metric", "labels"))
    path = str(tmp_path / "store")
    st.append_series_store(s.filter("t_us < 30"), path)
    st.append_series_store(s.filter("t_us >= 30"), path)
    assert spark.read.parquet(f"{path}/series").count() == 24
    cols = ["series", "instance", "t_us", "value"]
    for metric, matchers in (("a", [("n", "=~", "1|7")]), (None, [("kind", "!=", "odd"), ("instance", "=", "h1")]), ("b", []), ("c", []), ("a", [("n", "=", "99")])):
        got, want = st.select_stored(spark, path, metric, matchers), select_series(s, metric, matchers)
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    plan = st.select_stored(spark, path, "a", [("n", "=~", "1|7")])._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "isnotnull(metric" in plan.split("PartitionFilters", 1)[1]
    samples = plan[plan.index("FileScan"):].split("\n")[0]
    assert "labels" not in samples.split("ReadSchema")[-1]  # the scan of samples carries ids only
    assert st.select_stored(spark, str(tmp_path / "none")).count() == 0
