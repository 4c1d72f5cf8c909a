"""Benchmark decontamination with spaced seeds.

A mask such as ``1110111`` looks at some word positions of a window and ignores the others, so a
window still hits after words at the ignored positions were substituted. Hashes of the masked windows of the
benchmark items are joined with those of the documents; each hit proposes an alignment
(document, item, shift). The words of both are then compared along the shift, one point for an equal word
and minus one for a different one; the best stretch counts, then the best ones beside it, as
long as they have as many equal words as the smallest mask looks at. A document is contaminated by an item if
all its stretches together cover at least ``MIN_COVER`` percent of the item's words, ``MIN_WORDS`` different ones of
them equal (or the whole of a shorter item), or if one stretch alone has ``LONG_RUN`` equal words.

Words: white-space separated, lower case, letters and digits only. Items with fewer words than the
widest mask also get a mask of exactly their length.

Scale: hashes of documents are first tested against a bitmap of fixed size made from the
benchmark's; those that pass are joined with the benchmark's hashes (salted, as one passage may
be in a third of all documents). The words around hits travel with them, so texts are read once
and not shuffled. Nothing is collected but the bitmap and some item lengths.

Nulls: null or empty texts and items have no words and match nothing; a null document id is
kept as null, a null item id likewise. Repeated rows are reported as often as they differ in
id; rows with the same id and text give one row. Empty tables give no rows. Other
columns are ignored; ``drop_contaminated`` passes them through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import bitmap, materialise, out_batch, released, slabs, small_batches, table, text_or_empty, unused
from vigil.llm.words import alnum, gram_hashes, mix, word_hashes

MASKS = ["1110111", "11011011", "1101010111"]
MIN_WORDS, MIN_COVER, LONG_RUN = 8, 50, 13
FILTER_BITS = 1 << 24
#: Copies of the benchmark's hashes, so that a common passage is joined in as many parts.
SALTS = 16
SPAN = max(map(len, MASKS))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask's positions of every window, different for different masks."""
    h = gram_hashes(words, [i for i, c in enumerate(mask) if c == "1"])
    n = max(len(words) - len(mask) + 1, 0)
    return mix(h[:n] + np.uint64(len(mask) << 32 | int(mask, 2)))


def all_masks(short: list[int]) -> list[str]:
    """The masks, and a full one for each length of short items."""
    return MASKS + ["1" * n for n in sorted(set(short)) if 0 < n < SPAN]


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """``(item, item_id, words)``: word hashes of each item; ``item`` is a hash of id and words."""
    small_batches(benchmark.sparkSession)

    def run(batches):
        for b in released(batches):
            h, bounds, _ = word_hashes(b.column("text").to_pylist(), alnum)
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))],
                                             names=["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "item_id long, words array<long>").withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"])


def benchmark_hashes(items: DataFrame, masks: list[str]) -> DataFrame:
    """``(hash, item, at)`` of all masked windows of the items."""
    schema = pa.schema([("hash", pa.int64()), ("item", pa.int64()), ("at", pa.int32())])

    def run(batches):
        for b in released(batches):
            for item, words in zip(b.column("item").to_pylist(), b.column("words").to_pylist()):
                w = np.array(words, np.int64).view(np.uint64)
                for m in masks:
                    h = seed_hashes(w, m)
                    if len(h) and (m in MASKS or len(w) == len(m)):
                        yield out_batch(schema, [h.view(np.int64), np.full(len(h), item), np.arange(len(h))])

    return items.select("item", "words").mapInArrow(run, "hash long, item long, at int").distinct()


SEGMENTS = "doc_id long, text_hash long, first int, words array<long>, hashes array<long>, places array<int>"


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in the bitmap."""
    return h % np.uint64(FILTER_BITS), (h >> np.uint64(32)) % np.uint64(FILTER_BITS)


def segments(docs: DataFrame, bits: np.ndarray, masks: list[str], flank: int) -> DataFrame:
    """Stretches of documents around windows whose hash may be one of the benchmark's (``SEGMENTS``).

    ``flank``: words kept on either side of a hit, the length of the longest item.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for b in released(batches):
            texts, out = b.column("text").to_pylist(), [[] for _ in range(6)]
            for s, e in slabs([len(t) for t in texts]):
                w, bounds, _ = word_hashes(texts[s:e], alnum)
                doc = np.repeat(np.arange(e - s), np.diff(bounds))
                found = []
                for m in masks:
                    h = seed_hashes(w, m)
                    hit = np.ones(len(h), bool)
                    for slot in _slots(h):
                        hit &= ((bits[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)
                    at = np.flatnonzero(hit)
                    at = at[doc[at] == doc[at + len(m) - 1]] if len(at) else at
                    found.append((at, h[at]))
                place = np.concatenate([f[0] for f in found])
                order = np.argsort(place, kind="stable")
                place, hashes = place[order], np.concatenate([f[1] for f in found])[order]
                if not len(place):
                    continue
                # Hits less than two flanks apart in one document share a stretch.
                cut = np.flatnonzero((np.diff(place) > 2 * flank) | (np.diff(doc[place]) > 0)) + 1
                for p, h in zip(np.split(place, cut), np.split(hashes, cut)):
                    i = int(doc[p[0]])
                    a, z = max(int(bounds[i]), int(p[0]) - flank), min(int(bounds[i + 1]), int(p[-1]) + SPAN + flank)
                    row = (b.column("doc_id")[s + i].as_py(), b.column("text_hash")[s + i].as_py(), a - int(bounds[i]),
                           w[a:z].view(np.int64), h.view(np.int64), (p - a).astype(np.int32))
                    for col, v in zip(out, row):
                        col.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[c.split()[0] for c in SEGMENTS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, SEGMENTS)


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Ends of the stretch with the highest (equal - different), the first such."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.argmax(total[:end + 1] == low[end])), end


#: Equal words that a stretch beside the best one needs: those that the smallest mask looks at.
SEED_WORDS = min(m.count("1") for m in MASKS)


def stretches(equal: np.ndarray) -> list[tuple[int, int]]:
    """The best stretch, and left and right of it the best ones with at least ``SEED_WORDS`` equal words, and so on."""
    out, todo = [], [(0, len(equal))]
    while todo:
        a, z = todo.pop()
        x, y = best_stretch(equal[a:z])
        if y > x and (not out or int(equal[a + x:a + y].sum()) >= SEED_WORDS):
            out.append((a + x, a + y))
            todo += [(s, e) for s, e in ((a, a + x), (a + y, z)) if e - s >= SEED_WORDS]
    return out


def alignments(segs: DataFrame, items: DataFrame, masks: list[str]) -> DataFrame:
    """``(seg, item, start, end, place, same)``: compared stretches, in item words, their place in the segment, and the numbers of the equal item words."""
    hits = segs.select("doc_id", "text_hash", "first", "seg", F.inline(F.arrays_zip("hashes", "places")))
    hits = hits.withColumn("salt", F.pmod("seg", F.lit(SALTS)).cast("int"))
    bench = benchmark_hashes(items, masks).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shifts = hits.join(bench, (F.col("hashes") == F.col("hash")) & (hits["salt"] == bench["salt"])).select(
        "seg", "item", (F.col("places") - F.col("at")).alias("shift")).distinct()
    shifts = shifts.groupBy("seg", "item").agg(F.collect_list("shift").alias("shifts"))  # shifts of one stretch against one item
    schema = pa.schema([("seg", pa.int64()), ("item", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("place", pa.int32()), ("same", pa.list_(pa.int32()))])

    def run(batches):
        for b in released(batches):
            out = [[] for _ in range(6)]
            cols = [b.column(c) for c in ("seg", "item", "shifts", "words", "item_words")]
            for seg, item, shift, w, v in zip(*cols):
                w, v = np.array(w.as_py(), np.int64), np.array(v.as_py(), np.int64)
                for s in shift.as_py():
                    a, z = max(0, -s), min(len(v), len(w) - s)
                    equal = v[a:z] == w[a + s:z + s]
                    for x, y in stretches(equal):
                        for col, value in zip(out, (seg.as_py(), item.as_py(), a + x, a + y, a + x + s, a + x + np.flatnonzero(equal[x:y]))):
                            col.append(value)
            yield out_batch(schema, out)

    paired = shifts.join(segs.select("seg", "words"), "seg").join(items.select("item", F.col("words").alias("item_words")), "item")
    return paired.mapInArrow(run, "seg long, item long, start int, end int, place int, same array<int>")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_cover: int = MIN_COVER) -> DataFrame:
    """``(doc_id, text_hash, item_id, item_words, covered, equal, first_word, last_word)`` for every contaminated (document, item)."""
    items = materialise(benchmark_words(benchmark), "bench-items")
    sizes = items.select(F.size("words").alias("n")).groupBy(F.least("n", F.lit(SPAN)).alias("up_to")).agg(F.max("n").alias("n")).collect()  # at most SPAN + 1 rows
    masks = all_masks([r.n for r in sizes])
    two = F.explode(F.array(F.expr(f"hash & {FILTER_BITS - 1}"), F.expr(f"shiftright(hash, 32) & {FILTER_BITS - 1}"))).alias("bit")
    bits = bitmap(benchmark_hashes(items, masks).select(two), FILTER_BITS)
    segs = materialise(segments(docs, bits, masks, max([r.n for r in sizes], default=0)).withColumn("seg", F.monotonically_increasing_id()), "bench-segments")
    found = alignments(segs, items, masks).join(segs.select("seg", "doc_id", "text_hash", "first"), "seg")
    word = F.explode(F.sequence("start", F.col("end") - 1)).alias("word")
    cover = found.select("doc_id", "text_hash", "item", "same", word).groupBy("doc_id", "text_hash", "item", "word").agg(
        F.max(F.array_contains("same", F.col("word")).cast("int")).alias("same"))
    cover = cover.groupBy("doc_id", "text_hash", "item").agg(F.count(F.lit(1)).alias("covered"), F.sum("same").alias("equal"))
    best = found.groupBy("doc_id", "text_hash", "item").agg(
        F.max(F.size("same")).alias("longest"), F.min(F.col("first") + F.col("place")).alias("first_word"),
        F.max(F.col("first") + F.col("place") + F.col("end") - F.col("start") - 1).alias("last_word"))
    both = best.withColumnRenamed("item", "i").join(cover, (F.col("i") == F.col("item")) & best["doc_id"].eqNullSafe(cover["doc_id"]) & (best["text_hash"] == cover["text_hash"])).select(
        best["doc_id"], best["text_hash"], "item", "covered", "equal", "longest", "first_word", "last_word")
    n = F.size("words")
    named = both.join(items, "item").withColumn("item_words", n)
    whole = (F.col("item_words") < min_words) & (F.col("equal") >= F.col("item_words"))
    large = (F.col("equal") >= min_words) & (100 * F.col("covered") >= min_cover * F.col("item_words"))
    return named.filter(whole | large | (F.col("longest") >= LONG_RUN)).select("doc_id", "text_hash", "item_id", "item_words", "covered", "equal", "first_word", "last_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a contaminated alignment; all columns as they were."""
    bad_id, bad_hash = unused(docs, "bad_id", "bad_hash")
    bad = materialise(contaminated(docs, benchmark).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct(), "bench-bad")
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64(text_or_empty()) == F.col(bad_hash))
    return docs.join(bad, same, "left_anti")


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) whose passage is in the document, with the words it covers."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("item_words").cast("long"), F.col("covered").cast("long"), F.col("equal").cast("long").alias("equal_words"),
                        F.col("first_word").cast("long"), F.col("last_word").cast("long"))
