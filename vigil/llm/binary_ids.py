"""Token ids as binary shards: one zstandard frame per document, compressed with a shared dictionary.

File format of a shard, little endian::

    b"VGLIDS1\\n" | 32 bytes SHA-256 of the dictionary | frames, one after another
    index: n x (int64 doc_id, uint8 id is null, uint32 tokens, uint64 offset of the frame)
    uint64 offset of the index | uint64 n | b"VGLIDX1\\n"

A frame holds the ids of one document as unsigned 16-bit integers (32-bit ones if the
vocabulary needs them: byte 7 of the magic is then "L"). The dictionary lies beside the
shards as ``dictionary.zdict``. Any document is read with two seeks: index, frame.

The dictionary is trained on the serialized ids of a bounded sample: the ``SAMPLE_DOCS``
documents with the smallest hash among those of at most ``SAMPLE_BYTES`` bytes. All else
covers every document. Writers name files by task attempt; the manifest, written by Spark's
own commit protocol, lists the files of the attempts that counted, so a lost executor or a
second attempt leaves at most files that nobody reads.

Nulls: a null text is empty (its document holds the end id alone); a null id sorts first.
Repeated ids are ordered by a hash of the text; equal rows are written as often as they
come. An empty table gives no shards. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm import bpe
from vigil.llm.common import materialise, open_folder, out_batch, partitions, shared_path, small_batches, table, text_or_empty

MAGIC, TAIL = b"VGLIDS1\n", b"VGLIDX1\n"
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 1 << 15
DICT_BYTES = 64 << 10
INDEX = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("tokens", "<u4"), ("offset", "<u8")])
MANIFEST = "shard int, file string, n_docs long, n_tokens long, dict_sha256 string"
ROWS = "shard int, row long, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"
_MANIFEST_PA = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("dict_sha256", pa.string())])
_ROWS_PA = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def train_dictionary(docs: DataFrame, vocab: str, end_id: int, size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample; empty when there is nothing to train on."""
    import zstandard

    rows = docs.select("doc_id", text_or_empty().alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).withColumn("h", F.xxhash64("doc_id", "text"))
    last = rows.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h").alias("h")).first().h  # numbers first: only the sample's texts move
    rows = rows.filter(F.col("h") <= F.lit(last)).orderBy("h").limit(SAMPLE_DOCS).collect() if last is not None else []
    ids, off = bpe.PieceEncoder(vocab).encode([r.text for r in rows], end_id)
    samples = [ids[a:b].astype("<u2").tobytes() for a, b in zip(off, off[1:])]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: the ids themselves serve
        return b"".join(samples)[-size:]


def write_shards(docs: DataFrame, folder: str, dictionary: bytes, vocab: str, end_id: int, n: int) -> DataFrame:
    """Write shards in ascending ``doc_id`` order; returns the manifest, one row per shard (materialised)."""
    small_batches(docs.sparkSession, "14m")
    sha = hashlib.sha256(dictionary).digest()

    def write(batches):
        import zstandard

        part, files = TaskContext.get(), open_folder(folder)
        name = f"shard-{part.partitionId():06d}-{part.taskAttemptId()}.ids"
        ids_of = bpe.encoder(vocab, cache=900_000)
        wide = ids_of.tok.get_vocab_size() > 1 << 16
        kind = "<u4" if wide else "<u2"
        press = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        index, out, at, tokens = [], None, 0, 0
        for b in batches:
            if out is None:
                out = files[0].open_output_stream(f"{files[1]}/{name}")
                out.write(MAGIC[:6] + (b"L\n" if wide else b"1\n") + sha)
                at = len(MAGIC) + len(sha)
            ids, off = ids_of.encode(b.column("text"), end_id, slab=14_000_000)
            entry = np.zeros(len(b), INDEX)
            doc = b.column("doc_id")
            entry["doc_id"], entry["no_id"] = doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False)
            entry["tokens"] = np.diff(off)
            ids = ids.astype(kind)
            for i in range(len(b)):
                frame = press.compress(ids[off[i]:off[i + 1]].tobytes())
                entry["offset"][i] = at
                out.write(frame)
                at += len(frame)
            tokens += int(off[-1])
            index.append(entry)
        if out is not None:
            index = np.concatenate(index)
            out.write(index.tobytes() + np.array([at, len(index)], "<u8").tobytes() + TAIL)
            out.close()
            yield out_batch(_MANIFEST_PA, [[part.partitionId()], [name], [len(index)], [tokens], [sha.hex()]])

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange(n, F.asc_nulls_first("doc_id"), F.asc("h")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("h"))
    return materialise(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "ids-manifest")


def open_shard(stream) -> tuple[np.ndarray, bytes, np.dtype]:
    """Index, dictionary hash and id type of an open shard."""
    size = stream.size()
    stream.seek(size - 16 - len(TAIL))
    at, n = np.frombuffer(stream.read(16), "<u8")
    if stream.read(len(TAIL)) != TAIL:
        raise ValueError("not a shard of ids, or cut short")
    stream.seek(0)
    head = stream.read(len(MAGIC) + 32)
    if head[:6] != MAGIC[:6]:
        raise ValueError("not a shard of ids")
    stream.seek(int(at))
    return np.frombuffer(stream.read(int(n) * INDEX.itemsize), INDEX), head[len(MAGIC):], np.dtype("<u4" if head[6:7] == b"L" else "<u2")


def read_document(folder: str, file: str, row: int) -> np.ndarray:
    """Ids of one document: index, then its frame; nothing else is read."""
    import zstandard

    files, path = open_folder(folder)
    with files.open_input_file(f"{path}/dictionary.zdict") as f:
        dictionary = f.read()
    with files.open_input_file(f"{path}/{file}") as f:
        index, sha, kind = open_shard(f)
        if hashlib.sha256(dictionary).digest() != sha:
            raise ValueError("the dictionary is not the one that the shard was written with")
        f.seek(int(index["offset"][row]))
        end = int(index["offset"][row + 1]) if row + 1 < len(index) else f.size() - 16 - len(TAIL) - len(index) * INDEX.itemsize
        frame = f.read(end - int(index["offset"][row]))
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return np.frombuffer(press.decompress(frame), kind)


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the shards from the files: ``ROWS``; the files' dictionary hash is checked."""

    def read(batches):
        import zstandard

        files, path = open_folder(folder)
        with files.open_input_file(f"{path}/dictionary.zdict") as f:
            dictionary = f.read()
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for m in b.to_pylist():
                with files.open_input_file(f"{path}/{m['file']}") as f:
                    index, sha, kind = open_shard(f)
                    if sha != hashlib.sha256(dictionary).digest():
                        raise ValueError(f"{m['file']} was written with another dictionary")
                    start = np.cumsum(index["tokens"].astype(np.int64)) - index["tokens"]
                    ends = np.append(index["offset"][1:], f.size() - 16 - len(TAIL) - len(index) * INDEX.itemsize).astype(np.int64)
                    f.seek(len(MAGIC) + 32)
                    for a in range(0, len(index), 2000):
                        part, crc = index[a:a + 2000], []
                        for i, e in enumerate(part, a):
                            ids = np.frombuffer(press.decompress(f.read(int(ends[i] - e["offset"]))), kind)
                            if len(ids) != e["tokens"]:
                                raise ValueError(f"{m['file']}: row {i} has {len(ids)} ids, its index says {e['tokens']}")
                            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        yield out_batch(_ROWS_PA, [np.full(len(part), m["shard"]), np.arange(a, a + len(part)),
                                                   pa.array(part["doc_id"].copy(), mask=part["no_id"] != 0), start[a:a + len(part)],
                                                   part["tokens"].astype(np.int64), crc])

    n = manifest.count()  # shards, not documents
    return manifest.repartition(max(1, n), "shard").mapInArrow(read, ROWS)


def with_global_start(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """``start``: ids of all documents before, from the shards' totals (one row per shard)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("start_in_shard"))


def op4_dictionary_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids (end id 2) in dictionary-compressed shards, read back from the files."""
    import public_tokenizers

    vocab, docs = public_tokenizers.path("byte_bpe_50k.json"), table(spark, sf_dir, "documents")
    folder = shared_path(spark, "ids")
    dictionary = train_dictionary(docs, vocab, 2)
    files, path = open_folder(folder)
    files.create_dir(path)
    with files.open_output_stream(f"{path}/dictionary.zdict") as f:
        f.write(dictionary)
    manifest = write_shards(docs, folder, dictionary, vocab, 2, partitions(spark))
    rows = with_global_start(read_shards(manifest, folder), manifest)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "row")
