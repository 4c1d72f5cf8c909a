"""Best-fit packing of token sequences by large-item matching.

Lengths are whole numbers up to the capacity, so the table of counts per length has at most
``capacity`` rows at any input size. The plan is made on those counts: full pieces fill a
sequence each; lengths above one third of the capacity are matched greedily, largest first
with the largest partner that fits, at most two in a sequence; smaller lengths then go,
largest first, to the tightest gap that holds them, and open new sequences only when none
does. The plan is a list of intervals ``(length, ranks from-to, first sequence, items in a
sequence, offset)``; every piece finds its place from its rank among the pieces of its
length. Ranks come from counts of (length, salt), so one very common length is spread.

Cutting: a document longer than the capacity becomes full pieces and a first piece with the
rest; nothing else is cut.

Nulls: a null text is empty (the end id alone); a null id is kept as null. Repeated rows are
packed as often as they come. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm import bpe
from vigil.llm.common import materialise, out_batch, released, small_batches, table, text_or_empty

CAPACITY = 2048
#: Parts in which the pieces of one length are ranked.
SALTS = 64
#: Pieces a worker stores; it keeps them through the stages of a pipeline.
STORED = 200_000
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, salt int"
_PIECES_PA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("salt", pa.int32())])


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document with ``total`` ids."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(a, capacity) for a in range(first, total, capacity)]


def token_pieces(docs: DataFrame, vocab: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize every whole text once; one row per piece, ids as checksum only."""
    small_batches(docs.sparkSession, "2m")

    def pieces(batches):
        ids_of = bpe.encoder(vocab, STORED)
        for b in released(batches):
            ids, off = ids_of.encode(b.column("text"), end_id)
            salts = b.column("salt").to_pylist()
            out = [[] for _ in _PIECES_PA]
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                a, z = int(off[i]), int(off[i + 1])
                for k, (start, n) in enumerate(cut(z - a, capacity)):
                    for col, v in zip(out, (doc, k, start, n, zlib.crc32(ids[a + start:a + start + n].tobytes()), (salts[i] + k) % SALTS)):
                        col.append(v)
            yield out_batch(_PIECES_PA, out)

    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.withColumn("salt", salt).mapInArrow(pieces, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Intervals ``length, rank_lo, rank_hi, first sequence, items a sequence, offset`` and the number of sequences."""
    left = {s: c for s, c in counts.items() if c}
    used: dict[int, int] = defaultdict(int)  # ranks given out, by length
    intervals: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, count)
    bins = 0

    def give(s: int, n: int, first: int, each: int, offset: int) -> None:
        intervals.append((s, used[s], used[s] + n, first, each, offset))
        used[s] += n
        left[s] -= n

    # Large items: above a third, at most two in a sequence.
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            partner = next((t for t in large if left[t] and s + t <= capacity and (t != s or left[s] > 1)), None)
            if partner is None:
                n = left[s]
                give(s, n, bins, 1, 0)
                gaps[capacity - s].append((bins, n))
            elif partner == s:
                n = left[s] // 2
                give(s, 2 * n, bins, 2, 0)
                gaps[capacity - 2 * s].append((bins, n))
            else:
                n = min(left[s], left[partner])
                give(s, n, bins, 1, 0)
                give(partner, n, bins, 1, s)
                gaps[capacity - s - partner].append((bins, n))
            bins += n
    # Small items: tightest gap first; a run of equal gaps is filled at once.
    heap = sorted(g for g in gaps if g)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        skipped = []
        while left[s]:
            while heap and (heap[0] < s or not gaps[heap[0]]):
                g = heapq.heappop(heap)
                if gaps[g]:
                    skipped.append(g)
            if heap:
                g = heap[0]
                first, n = gaps[g].pop()
            else:
                g, first, n = capacity, bins, -(-left[s] // (capacity // s))
                bins += n
            each = g // s
            full = min(n, left[s] // each)
            rest = left[s] - full * each if full < n else 0
            if full:
                give(s, full * each, first, each, capacity - g)
                _leave(gaps, heap, g - each * s, first, full)
            if rest:
                give(s, rest, first + full, rest, capacity - g)
                _leave(gaps, heap, g - rest * s, first + full, 1)
            if n > full + bool(rest):
                _leave(gaps, heap, g, first + full + bool(rest), n - full - bool(rest))
        for g in skipped:
            heapq.heappush(heap, g)
    return np.array(sorted(intervals), np.int64).reshape(-1, 6), bins


def _leave(gaps: dict, heap: list[int], gap: int, first: int, n: int) -> None:
    if gap:
        gaps[gap].append((first, n))
        heapq.heappush(heap, gap)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (a stored table with ``length`` and ``salt``)."""
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    intervals, _ = plan(by_length, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(F.broadcast(firsts), ["length", "salt"])  # at most capacity x SALTS rows
    ranked = ranked.withColumn("rank", F.col("first") + F.col("rank")).drop("first", "salt")

    def place(batches):
        span = 1 + int(intervals[:, 2].max()) if len(intervals) else 1
        keys = intervals[:, 0] * span + intervals[:, 1]
        for b in released(batches):
            length, at = b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            row = intervals[np.searchsorted(keys, length * span + at, side="right") - 1]
            k = at - row[:, 1]
            cols = [b.column(n) for n in ("doc_id", "piece", "start")] + [pa.array(length), b.column("ids_crc32"),
                    pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + (k % row[:, 4]) * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PACKED.split(", ")])

    return ranked.mapInArrow(place, PACKED)


def pack_documents(docs: DataFrame, vocab: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialise(token_pieces(docs, vocab, end_id, capacity), "pieces"), capacity)


def op9_large_item_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids, one row per piece."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
