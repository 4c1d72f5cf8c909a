"""Samples stored by series: a table of series, and samples that carry a series id only.

``<path>/series`` has one row per series (id, metric, instance, series, labels), by metric.
``<path>/samples`` has (id, t_us, value), by metric and by shard of the id. So a label matcher
costs by series, not by sample, and the series it leaves prune the shards of the samples at run time.

The id is the MD5 of the series text. Appending adds only series not known yet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.series import select_series

SHARDS = 64
SERIES = "id binary, instance string, series string, labels map<string,string>, shard int, metric string"
SAMPLES = "id binary, t_us bigint, value double, metric string, shard int"


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_series_store(S: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Store samples (``metric, labels, instance, series, t_us, value``); a hot shard is several files (rebalanced)."""
    spark = S.sparkSession
    ids = S.select("metric", "instance", "series", "labels", "t_us", "value", F.unhex(F.md5("series")).alias("id"),
                   F.pmod(F.xxhash64("series"), F.lit(shards)).cast("int").alias("shard"))
    series = ids.groupBy("id", "shard", "metric", "instance", "series").agg(F.first("labels").alias("labels"))
    series = series.join(_known(spark, f"{path}/series", SERIES).select("metric", "id"), ["metric", "id"], "left_anti")
    series.select("id", "instance", "series", "labels", "shard", "metric").write.mode("append").partitionBy("metric").parquet(f"{path}/series")
    rows = ids.select("id", "t_us", "value", "metric", "shard").hint("rebalance", "metric", "shard").sortWithinPartitions("metric", "shard", "id", "t_us")
    rows.write.mode("append").partitionBy("metric", "shard").parquet(f"{path}/samples")


def select_stored(spark: SparkSession, path: str, metric: str | None = None, matchers: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """As ``select_series`` over the stored samples: matchers on the series table, then a join on (metric, shard, id).

    ``metric`` and ``shard`` are folders of both tables or of the samples, so a metric prunes at
    planning, and the shards of the series found prune when the query runs.
    """
    series = select_series(_known(spark, f"{path}/series", SERIES), metric, matchers)
    samples = _known(spark, f"{path}/samples", SAMPLES)
    if metric is not None:
        samples = samples.filter(F.col("metric") == metric)
    return samples.join(series, ["metric", "shard", "id"]).select("metric", "labels", "instance", "series", "t_us", "value")
