"""SimHash near-duplicates: pigeonhole blocks propose, Hamming distance decides, components are linked.

1. A document's fingerprint is the majority of the bits of the XXH64 of its ``words``-word
   shingles, repeats included. Documents with equal fingerprints are one class.
2. Of ``distance + 1`` blocks of bits, two fingerprints at most ``distance`` bits apart share
   one. So each distinct fingerprint is dealt to one bucket a block, by the bits of that block.
3. A bucket of at most ``MEMBERS`` fingerprints is compared in one task. A larger one is dealt
   again by the same rule: the bits that its key leaves open are split into ``distance + 1``
   blocks, of which close pairs share one. That goes on until every bucket fits: with 12 open
   bits or fewer there are no more than ``MEMBERS`` different fingerprints. No pair is lost.
4. A bucket reports a spanning forest of its links, so dense groups give no more links than
   they have members. Components of all forests are those of all links.

Scale: buckets are counted (summed before the shuffle) before they are dealt, so no task ever
gets a large one. Copies collapse to their fingerprint first.

Null and empty texts and texts without words have fingerprint zero and are linked like any
other. Rows with a null id are linked as well, and named after the smallest id of their
component (null if it has none). Repeated rows, and rows that repeat an id with other texts, are
linked by their fingerprints. An empty table gives no rows. Other columns are ignored;
``drop_near_duplicates`` passes them through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import materialise, partitions, small_batches, table, text_or_empty, unused
from vigil.llm.neardup import components

WORDS, DISTANCE, SEED = 4, 4, 42
#: Fingerprints of a bucket that one task compares side by side: 2 to the power of 12.
MEMBERS = 4096
#: Shingles whose bits are counted at once.
_SLAB = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits, unsigned; bit k is 1 if it is set in over half of the shingle hashes."""
    found = text.translate(_LOWER).split()  # at the six ASCII white-space bytes
    if not found:
        return 0
    line = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[min(words, len(found)) - 1:]
    starts = starts[:len(ends)]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for a in range(0, len(ends), _SLAB):
        h = np.fromiter([digest(line[s:e], SEED) for s, e in zip(starts[a:a + _SLAB].tolist(), ends[a:a + _SLAB].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BIT[2 * ones > len(ends)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, bits)`` of every row, ``bits`` as a signed 64-bit number."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            bits = np.fromiter((fingerprint(t.as_py(), words) for t in b.column("text")), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "doc_id long, bits long")


def blocks(open_bits: int, parts: int) -> list[int]:
    """``open_bits`` split into ``parts`` masks of nearly equal size, neighbours together."""
    at = [k for k in range(64) if open_bits >> k & 1]
    return [sum(1 << k for k in at[len(at) * i // parts:len(at) * (i + 1) // parts]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(bits: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct ``bits``: each new one is reached from one that is linked."""
    if len(bits) <= 256 and np.count_nonzero(np.bitwise_count(bits[:, None] ^ bits) <= distance) == len(bits):
        return []
    left, out = bits, []
    while len(left) > 1:
        reached, left, at = left[:1], left[1:], 0
        while at < len(reached) and len(left):
            near = np.bitwise_count(left ^ reached[at]) <= distance
            if near.any():
                out += [(int(reached[at]), int(x)) for x in left[near]]
                reached, left = np.concatenate([reached, left[near]]), left[~near]
            at += 1
    return out


def _bucket_links(buckets: DataFrame, distance: int) -> DataFrame:
    """``(a, b)``: forests of all buckets, none of which has more than ``MEMBERS`` fingerprints."""

    def links(t: pa.Table) -> pa.RecordBatch:
        mask, key, bits = (t.column(c).to_numpy() for c in ("mask", "key", "bits"))
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        found = [link for part in np.split(bits.view(np.uint64), cuts) for link in _forest(part, distance)]
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) < 2 * MEMBERS:
                continue
            mask, key = held.column("mask").to_numpy(), held.column("key").to_numpy()
            cut = int(np.flatnonzero((mask == mask[-1]) & (key == key[-1]))[0])  # the last bucket may go on
            yield links(held.slice(0, cut))
            held = held.slice(cut)
        if held is not None and len(held):
            yield links(held)

    dealt = buckets.repartition(partitions(buckets.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")
    return dealt.select("mask", "key", "bits").mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)``: links that span the components of all ``bits`` at most ``distance`` bits apart (distinct ``bits``)."""
    parts, found, masks = distance + 1, None, [0]
    rows = distinct.select("bits", F.lit(0).cast("long").alias("mask"))
    while True:
        # Each bucket is dealt again by the blocks of the bits that it leaves open.
        deeper = {m: [m | b for b in blocks(~m & (1 << 64) - 1, parts) if b] for m in masks}
        choice = F.coalesce(*(F.when(F.col("mask") == _signed(m), F.array(*(F.lit(_signed(d)).cast("long") for d in more))) for m, more in deeper.items()))
        masks = sorted({d for more in deeper.values() for d in more})
        rows = rows.withColumn("mask", F.explode(choice)).withColumn("key", F.col("bits").bitwiseAND(F.col("mask")))
        rows = rows if found is None else rows.distinct()  # two masks may lead to the same one
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        rows = materialise(rows.join(sizes, ["mask", "key"]), "sim-buckets")
        small = _bucket_links(rows.filter(F.col("members") <= MEMBERS), distance)
        found = small if found is None else found.unionByName(small)
        rows = rows.filter(F.col("members") > MEMBERS).select("bits", "mask")
        if rows.isEmpty():
            return materialise(found.distinct(), "sim-links")
        masks = [m & (1 << 64) - 1 for m in (r.mask for r in rows.select("mask").distinct().collect())]


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, bits, component_id, kept)`` for every row of ``docs``."""
    signed = materialise(fingerprints(docs, words), "sim-bits")
    classes = signed.groupBy("bits").agg(F.min("doc_id").alias("least"))
    linked = components(links(classes.select("bits"), distance))
    named = classes.join(linked.withColumnRenamed("id", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.select("bits", "component").join(smallest, "component").select("bits", "component_id")
    return signed.join(ids, "bits").select("doc_id", "bits", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The documents that are the smallest id of their component, or have none; all columns as they were."""
    (sim_id,) = unused(docs, "sim_id")
    gone = near_duplicates(docs, words, distance).filter("not kept").select(F.col("doc_id").alias(sim_id)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(sim_id), "left_anti")


def op12_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents at 4 or fewer differing bits of 4-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
