"""Helpers shared by the training-data operators: shared scratch tables, Arrow slabs, shared-folder files."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir

#: Characters of text a Python worker handles at once; bounds its numpy arrays.
SLAB_CHARS = 1_000_000
#: The six ASCII white-space characters that end a word.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of about ``size`` at most, so a worker never holds a whole partition of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@cache
def _trim():
    """glibc's ``malloc_trim``; with another C library, nothing to call."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release_memory() -> None:
    """Give freed memory back to the system: Arrow and malloc keep it, and Spark reuses Python workers for all later stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches as they come; what the work on one has freed is given back before the next."""
    for b in batches:
        yield b
        del b
        release_memory()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where ``df`` has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def slabs(lengths: list[int], limit: int = SLAB_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges ``[a, b)`` of rows whose lengths add up to at most ``limit`` (one row at least)."""
    a = total = 0
    for i, n in enumerate(lengths):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def out_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def open_folder(uri: str):
    """(pyarrow filesystem, path) of a folder given as Hadoop-style URI (``file:/x``, ``hdfs://...``, ``s3://...``)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """The set of numbers ``bit`` (from 0 below ``size``) as uint32 words: at most ``size / 32`` rows reach the driver."""
    words = bits.groupBy(F.floor(F.col("bit") / 32).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("word"))
    out = np.zeros(size // 32, np.uint32)
    got = words.toPandas()
    out[got["at"].to_numpy()] = got["word"].to_numpy()
    return out
