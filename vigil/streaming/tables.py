"""Tables that a stream maintains and readers see whole: versions, switched by a commit file.

A version's rows are written first; then a small file below ``commits`` names the folders that
make it up. Creating that file is the switch: a reader takes the newest commit, so it sees the
version before or the one after, never an emptied folder. A batch that is replayed starts from the
newest commit before its own version and replaces what it wrote, so replays change nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionedTable:
    """A small table that each version replaces."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if not f.getPath().getName().startswith(("_", "."))) if fs.exists(p) else []

    def manifest(self, version: int) -> dict:
        """What the version is made of, by part: the version that wrote the part."""
        fs, p = self._fs(f"{self.root}/commits/{version:020d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, parts: dict) -> None:
        fs, p = self._fs(f"{self.root}/commits/{version:020d}")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(json.dumps(parts).encode()))
        finally:
            stream.close()

    def before(self, version: int | None) -> int | None:
        known = [v for v in self.versions() if version is None or v < version]
        return known[-1] if known else None

    def _folder(self, version: int, part: str) -> str:
        return f"{self.root}/data/v{version}/part={part}"

    def read(self, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """The newest version, or a given one; empty if there is none."""
        version = self.before(None) if version is None else version
        found = {} if version is None else self.manifest(version)
        folders = [self._folder(v, p) for p, v in found.items() if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(self._folder(version, "all"))
        self.commit(version, {"all": version})

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the newest ``keep`` commits and the folders that only older ones name."""
        known = self.versions()
        wanted = {(v, p) for k in known[-keep:] for p, v in self.manifest(k).items()}
        for k in known[:-keep]:
            for p, v in self.manifest(k).items():
                if (v, p) not in wanted:
                    fs, path = self._fs(self._folder(v, p))
                    fs.delete(path, True)
            fs, path = self._fs(f"{self.root}/commits/{k:020d}")
            fs.delete(path, False)


class KeyedTable(VersionedTable):
    """One row per key, dealt into ``buckets`` by key: a batch rewrites only the buckets that its keys fall into."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: Sequence[str], order: Sequence[str], buckets: int = 64):
        super().__init__(spark, root, schema)
        self.key, self.order, self.buckets = list(key), list(order), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("string")

    def upsert(self, rows: DataFrame, version: int) -> None:
        """The newest row of every key by ``order``, of ``rows`` and of the version before."""
        names = self.schema.names
        rows = rows.select(*names).withColumn("part", self._bucket())
        rest = [c for c in names if c not in self.key]

        def newest(df: DataFrame) -> DataFrame:
            return df.groupBy(*self.key, "part").agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_row")).select(*self.key, "_row.*", "part")

        rows = newest(rows)
        touched = sorted(r.part for r in rows.select("part").distinct().collect())  # at most ``buckets``
        base = self.before(version)
        parts = {} if base is None else self.manifest(base)
        old = self.read(base, touched) if base is not None else self.spark.createDataFrame([], self.schema)
        merged = newest(old.withColumn("part", self._bucket()).unionByName(rows)).select(*names, "part")
        merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/data/v{version}")
        self.commit(version, {**parts, **{p: version for p in touched}})


def newest_rows(table: VersionedTable, batch: DataFrame, version: int, n: int, *order: str) -> None:
    """Keep the newest ``n`` rows: those of the batch (tops of its partitions, merged) with those of the version before."""
    last = table.before(version)
    by = [F.col(c).desc() for c in order]
    top = batch.select(*table.schema.names).orderBy(*by).limit(n)
    if last is not None:
        top = top.unionByName(table.read(last)).orderBy(*by).limit(n)
    table.replace(top.coalesce(1), version)
