"""A partitioned topic of messages in files: a Python data source that reads and streams it by offsets.

Layout: ``<topic>/partition=<p>/<first>-<next>.jsonl``, one JSON object ``{"key", "value"}`` a line, the
names giving the offsets (from 0, gapless in a partition). Messages with the same key go to
the same partition. A reader starts at the earliest offset; a stream's progress is one offset a partition,
kept by its checkpoint and moved on only when a batch has succeeded, a message that fails for
good included (it is read, judged and put aside, see ``split_bad_records``).

Partitions of a batch are read by different tasks, file by file as Arrow batches.
"""

from __future__ import annotations

import io
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "message_topic"
SCHEMA = "partition int, offset long, key string, value string"
_FILE = re.compile(r"(\d{20})-(\d{20})\.jsonl$")
#: Messages of an Arrow batch.
_ROWS = 10_000


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def segments(uri: str) -> dict[int, list[tuple[int, int, str]]]:
    """Per partition: ``(first offset, next offset, path)`` of its files, in order."""
    from pyarrow import fs

    files, path = _open(uri)
    out: dict[int, list] = {}
    for f in files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        name, part = _FILE.search(f.path), re.search(r"/partition=(\d+)/", f.path)
        if name and part:
            out.setdefault(int(part[1]), []).append((int(name[1]), int(name[2]), f.path))
    return {p: sorted(s) for p, s in out.items()}


class Range(InputPartition):
    """Offsets ``[first, until)`` of a partition."""

    def __init__(self, partition: int, first: int, until: int):
        super().__init__((partition, first, until))
        self.partition, self.first, self.until = partition, first, until


class _Reading:
    def __init__(self, options):
        self.path = options["path"]

    def read(self, r: Range):
        if r is None:  # Spark reads nothing so if there are no partitions
            return
        files, _ = _open(self.path)
        for first, following, path in segments(self.path).get(r.partition, []):
            if following <= r.first or first >= r.until:
                continue
            rows, offset = [], first
            with files.open_input_stream(path) as stream:
                for line in io.TextIOWrapper(stream, "utf-8", newline="\n"):
                    if r.first <= offset < r.until:
                        m = json.loads(line)
                        rows.append((r.partition, offset, m.get("key"), m.get("value")))
                    offset += 1
                    if len(rows) == _ROWS:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["partition", "offset", "key", "value"])


class TopicReader(_Reading, DataSourceReader):
    """Everything in the topic now, a task per file."""

    def partitions(self):
        return [Range(p, first, following) for p, found in segments(self.path).items() for first, following, _ in found]


class TopicStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {str(p): found[-1][1] for p, found in segments(self.path).items()}

    def partitions(self, start: dict, end: dict):
        known = segments(self.path)
        return [Range(int(p), max(first, start.get(p, 0)), min(following, until)) for p, until in end.items()
                for first, following, _ in known.get(int(p), []) if first < until and following > start.get(p, 0)]

    def commit(self, end: dict) -> None:
        """Spark's checkpoint keeps the offsets; the files stay for other readers."""


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TopicReader(self.options)

    def streamReader(self, schema):
        return TopicStreamReader(self.options)


def read_topic(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """``partition, offset, key, value`` of a topic folder."""
    spark.dataSource.register(TopicSource)
    return (spark.readStream if streaming else spark.read).format(FORMAT).option("path", path).load()


#: Files that an append writes to a partition, at most; each is written by a task and read by one.
WRITERS = 8


def append_messages(messages: DataFrame, path: str, partitions: int = 4, writers: int = WRITERS) -> None:
    """Append ``key, value`` rows, each key to its partition, numbered from the end of that partition.

    A partition's messages are dealt to ``writers`` tasks by content, which write a file each; two appends at the same time are not provided for.
    """
    spark, ends = messages.sparkSession, {p: found[-1][1] for p, found in segments(path).items()}
    token = uuid.uuid4().hex

    def write(batches):
        files, root = _open(path)
        open_files: dict[int, list] = {}
        for b in batches:
            lines: dict[int, list] = {}
            for p, line in zip(*(c.to_pylist() for c in b.columns)):
                lines.setdefault(p, []).append(line)
            for p, found in lines.items():
                if p not in open_files:
                    files.create_dir(f"{root}/partition={p}", recursive=True)
                    name = f"{root}/partition={p}/.{token}-{uuid.uuid4().hex}"
                    open_files[p] = [name, files.open_output_stream(name), 0]
                open_files[p][1].write(("\n".join(found) + "\n").encode())
                open_files[p][2] += len(found)
        for p, (name, stream, n) in open_files.items():
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], names=["partition", "file", "n"])

    part = F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int").alias("partition")
    line = F.to_json(F.struct("key", "value"), {"ignoreNullFields": "false"}).alias("line")  # line breaks are escaped
    dealt = messages.select(part, line).repartition(partitions * writers, "partition", F.pmod(F.xxhash64("line"), F.lit(writers)))
    written = dealt.mapInArrow(write, "partition int, file string, n long").collect()  # a row a file
    files, root = _open(path)
    for r in sorted(written, key=lambda r: (r.partition, r.file)):  # the name makes a file part of the topic
        first = ends.get(r.partition, 0)
        ends[r.partition] = first + r.n
        files.move(r.file, f"{root}/partition={r.partition}/{first:020d}-{first + r.n:020d}.jsonl")
