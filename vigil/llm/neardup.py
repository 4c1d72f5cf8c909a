"""Near-duplicate documents: MinHash bands propose, odd sketches screen, full shingle sets confirm.

1. Every document gets its shingle set, a MinHash signature, band keys, the odd sketch of its
   samples and the odd sketch of its whole set. Documents with equal sets are one class, of
   which the smallest id stands for all.
2. Classes that share a band key form a bucket. In each bucket all are paired with the smallest
   id (a star); pairs whose sketches allow the similarity are confirmed on full sets.
3. Components of the confirmed links. Documents in buckets that hold more than one component
   are dealt again, by their rarest shingles (``rare_groups``): two sets similar enough share one
   of these. Members of a group are compared across components inside the task, by the places of
   the shingle and by sketch; pairs that stay are compared by sketches as wide as the sets
   (``screen``), then confirmed. First each member's nearest partner is, then, over the
   components found by then, all that still lie across.

So links inside a class or a component are never spelled out as pairs, and no bucket is cut.
Sizes, places and the sketches of whole sets refuse no pair that is similar enough (see
``minhash.set_sketch``); the sketch of the samples leaves six standard errors. Hot buckets: the
star is a skew-splittable join; a group of more than ``PART`` members is compared in pairs of
blocks, and two blocks of one component are no pair, so a component that holds nearly all of
a group meets only the few others.

Nulls and empty texts have an empty set: no links, kept, own component (null for a null id,
which takes part in no link). Repeated rows are copies. Rows that repeat an id with other
texts are linked by their sets like any others. Empty tables give no rows. Other columns are
ignored; ``drop_near_duplicates`` passes them through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import minhash
from vigil.llm.common import bitmap, materialise, partitions, released, small_batches, table, text_or_empty, unused

#: Members of a group that are compared in one unit; a larger group is dealt as pairs of blocks of this size.
PART = 1_024
#: Slots by which shingles are counted, to put them in one order from rare to frequent.
SLOTS, RANGE = 1 << 20, 1 << 12
FILTER_BITS = 1 << 23
SIGNED = "doc_id long, set_key string, n long, bands array<long>, odd array<long>, whole array<long>"


def _lists(rows: list[np.ndarray], width: int) -> pa.Array:
    """Equal rows of int64 as a list column; an empty row becomes an empty list."""
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int64()))


def sign(docs: DataFrame, words: int) -> DataFrame:
    """``SIGNED`` for every document; texts are read once and go no further."""
    small_batches(docs.sparkSession)

    def run(batches):
        none = np.zeros(0, np.int64)
        for b in released(batches):
            sets = minhash.shingle_sets(b.column("text").to_pylist(), words)
            signs = [minhash.signature(s) if len(s) else None for s in sets]
            cols = [b.column("doc_id"), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]), pa.array([len(s) for s in sets], pa.int64()),
                    _lists([none if g is None else minhash.band_keys(g) for g in signs], minhash.BANDS),
                    _lists([none if g is None else minhash.odd_sketch(g) for g in signs], 8),
                    _lists([none if g is None else minhash.set_sketch(s) for s, g in zip(sets, signs)], 16)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "set_key", "n", "bands", "odd", "whole"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, SIGNED)


def _set_rows(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``(id, members)``: the shingle sets of the documents named, as bytes of sorted hashes."""
    bits = bitmap(ids.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit")), FILTER_BITS)
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("slot")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).filter("id is not null").select("id", "text", slot)

    def run(batches):
        for b in released(batches):
            at = b.column("slot").to_numpy()
            b = b.filter(pa.array((bits[at >> 5] >> (at & 31) & 1).astype(bool)))
            sets = minhash.shingle_sets(b.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set_key", "members"])

    found = rows.mapInArrow(run, "id long, set_key string, members binary")
    return found.join(ids, ["id", "set_key"]).groupBy("id", "set_key").agg(F.first("members").alias("members"))


def _flips(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _allowed(n1, n2, whole, odd, percent: int):
    """Sketches and sizes allow ``100 * shared >= percent * union``; no such pair is refused by the sizes or ``whole``."""
    differ = (100 - percent) * (n1 + n2) / (100 + percent)
    return (whole <= differ) & (odd <= minhash.most_flips(percent / 100))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets have ``100 * shared >= percent * union`` (stored)."""
    left = sets.select(F.col("id").alias("b"), F.col("members").alias("mb"))
    right = sets.select(F.col("id").alias("a"), F.col("members").alias("ma"))

    def run(batches):
        for b in released(batches):
            keep = []
            for x, y in zip(b.column("ma"), b.column("mb")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    small_batches(pairs.sparkSession)
    joined = pairs.join(left, "b").join(right, "a").select("a", "b", "ma", "mb")
    return materialise(joined.mapInArrow(run, "a long, b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of all ids in the links ``(a, b)``: the smallest id reachable.

    Alternates large and small stars (each id with its neighbours points to the smallest of
    them) until all links are stars around smallest ids. Neighbours are never gathered; a hot id
    is a skewed join. A few rounds suffice, as each at least halves the paths.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = materialise(edges, "cc")
    # Done when no id has two smaller neighbours and no smaller neighbour has one itself.
    while not (edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty()
               and edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialise(small.select("e.u", "e.v").filter("u > v").distinct(), "cc")
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")),
                                          F.struct(F.col("v").alias("id"), F.col("v").alias("component")))).alias("e")).select("e.*").distinct()


def _allowed_pairs(i: np.ndarray, j: np.ndarray, n: np.ndarray, rest: np.ndarray, whole: np.ndarray, odd: np.ndarray, percent: int, flips: int) -> tuple[np.ndarray, ...]:
    """The pairs of rows that sizes, places in the order of shingles and sketches allow, and their flipped bits."""
    room = (100 - percent) * (n[i] + n[j])
    ok = np.minimum(rest[i], rest[j]) * (100 + percent) >= percent * (n[i] + n[j])
    i, j, room = i[ok], j[ok], room[ok]
    z = np.bitwise_count(whole[i] ^ whole[j]).sum(1, dtype=np.int64)
    ok = z * (100 + percent) <= room
    i, j, z = i[ok], j[ok], z[ok]
    ok = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) <= flips
    return i[ok], j[ok], z[ok]


def _open_sets(buckets: DataFrame, labels: DataFrame, first: DataFrame, sets: DataFrame) -> DataFrame:
    """``(key, id, n, odd, whole, wide, members)``: the sets in band buckets that hold several components (stored)."""
    named = buckets.select("bucket", "id", "set_key").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = named.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2")
    ids = named.join(spread.select("bucket"), "bucket", "left_semi").select("id", "set_key").distinct()
    full = ids.join(first.select("id", "set_key", "n", "odd", "whole"), ["id", "set_key"]).join(sets, ["id", "set_key"])
    return materialise(widened(full.select(F.monotonically_increasing_id().alias("key"), "id", "n", "odd", "whole", "members")), "near-open")


def widened(open_: DataFrame) -> DataFrame:
    """``open_`` with ``wide``: the odd sketch of the whole set, four to eight bits a member."""
    small_batches(open_.sparkSession)

    def run(batches):
        for b in released(batches):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in b.column("members")]
            wide = [minhash.set_sketch(x, max(minhash.SET_BITS, 1 << (4 * len(x) - 1).bit_length())).tobytes() for x in sets]
            yield b.append_column("wide", pa.array(wide, pa.binary()))

    return open_.mapInArrow(run, "key long, id long, n long, odd array<long>, whole array<long>, members binary, wide binary")


def screen(pairs: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that the wide sketches allow; a wider one is folded to the width of the other."""
    sides = [open_.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab"]

    def run(batches):
        for b in released(batches):
            keep = []
            for n1, n2, x, y in zip(*(b.column(c).to_pylist() for c in ("na", "nb")), b.column("wa"), b.column("wb")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                least = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(w.reshape(-1, least), 0) for w in (x, y))
                keep.append(int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (100 - percent) * (n1 + n2))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    small_batches(pairs.sparkSession)
    return pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long").distinct()


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(10)).astype(np.int64) & (SLOTS - 1)


def _slot_counts(open_: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each slot, at most 32,767: 2 MB reach the driver, whatever the input."""
    small_batches(open_.sparkSession)

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in released(batches):
            for x in b.column("members"):
                np.add.at(total, _slots(np.frombuffer(x.as_py(), np.uint64)), 1)
        full = np.flatnonzero(total)
        for a in range(0, len(full), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(full[a:a + 65_536]), pa.array(total[full[a:a + 65_536]])], names=["slot", "n"])

    def pack(t: pa.Table) -> pa.Table:
        slot = t.column("slot").to_numpy()
        row = np.zeros(RANGE, "<i2")
        row[slot % RANGE] = t.column("n").to_numpy()
        return pa.table({"at": [int(slot[0]) // RANGE], "counts": pa.array([row.tobytes()], pa.binary())})

    summed = open_.select("members").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.least(F.sum("n"), F.lit(32_767)).alias("n"))
    out = np.zeros(SLOTS, np.int16)
    for r in summed.groupBy(F.floor(F.col("slot") / RANGE)).applyInArrow(pack, "at long, counts binary").collect():
        out[r.at * RANGE:(r.at + 1) * RANGE] = np.frombuffer(r.counts, "<i2")
    return out


def rare_groups(open_: DataFrame, percent: int) -> DataFrame:
    """``(bucket, key, id, rest)``: the groups in which the sets of ``open_`` meet all partners that ``percent`` allows (stored).

    All shingles have one order, by the count of their slot, then by value. Two sets that share enough
    share one of the first ``n - ceil(percent * n / 100) + 1`` of each, so a set joins the groups of these alone.
    A shingle whose slot counts one set has no group. ``rest`` is the number of members from this one on:
    where it is the first that two sets share, they share no more than the smaller ``rest``.
    """
    counts = _slot_counts(open_)

    def run(batches):
        for b in released(batches):
            rare, rest = [], []
            for x in b.column("members"):
                x = np.frombuffer(x.as_py(), np.uint64)
                count = counts[_slots(x)]
                head = np.lexsort((x, count))[:len(x) - -(-percent * len(x) // 100) + 1]
                at = np.flatnonzero(count[head] > 1)
                rare.append(x[head[at]])
                rest.append(len(x) - at)
            if rare:
                each = [len(x) for x in rare]
                cols = [np.concatenate(rare).view(np.int64), *(np.repeat(b.column(c).to_numpy(), each) for c in ("key", "id")), np.concatenate(rest)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "key", "id", "rest"])

    small_batches(open_.sparkSession)
    groups = materialise(open_.select("key", "id", "members").mapInArrow(run, "bucket long, key long, id long, rest long"), "near-rare")
    several = groups.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("bucket")
    return materialise(groups.join(several, "bucket", "left_semi"), "near-groups")


def _units(named: DataFrame, block: int) -> DataFrame:
    """``(unit, bucket, side, key, id, rest, component)``: the members of groups with several components, in units of a bounded size.

    A group of up to ``block`` members is a unit. A larger one is dealt to blocks, a component of more than
    ``block`` members to blocks of its own; each pair of blocks is a unit, but for two blocks of the same component.
    """
    each = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    spread = each.groupBy("bucket").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("components")).filter("components > 1").select("bucket", "m")
    small = named.join(spread.filter(F.col("m") <= block), "bucket").select(F.col("bucket").alias("unit"), "bucket", F.lit(0).alias("side"), "key", "id", "rest", "component")

    large = each.join(spread.filter(F.col("m") > block), "bucket").withColumn("solo", F.col("c") > block)
    cut = F.when(F.col("solo"), F.pmod(F.xxhash64("key"), F.ceil(F.col("c") / block))).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("m") / block)))
    dealt = named.join(large, ["bucket", "component"]).withColumn("block", F.struct("solo", F.when(F.col("solo"), F.col("component")).otherwise(0).alias("own"), cut.alias("cut")))
    blocks = dealt.select("bucket", "block").distinct()
    x, y = blocks.select("bucket", F.col("block").alias("x")), blocks.select("bucket", F.col("block").alias("y"))
    pairs = x.join(y, "bucket").filter((F.col("x") <= F.col("y")) & ~(F.col("x.solo") & F.col("y.solo") & (F.col("x.own") == F.col("y.own"))))
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("block")))).otherwise(
        F.array(F.struct(F.lit(1).alias("side"), F.col("x").alias("block")), F.struct(F.lit(2).alias("side"), F.col("y").alias("block"))))
    placed = pairs.select(F.xxhash64("bucket", "x", "y").alias("unit"), "bucket", F.explode(sides).alias("s")).select("unit", "bucket", "s.side", "s.block")
    return small.unionByName(placed.join(dealt, ["bucket", "block"]).select("unit", "bucket", "side", "key", "id", "rest", "component"))


def _across(groups: DataFrame, open_: DataFrame, labels: DataFrame, percent: int, nearest: bool, block: int = PART) -> DataFrame:
    """Pairs ``(a, b)`` across components that sketches allow, in groups that hold several components.

    ``nearest``: for each member of a unit only its nearest allowed partner, by sketch; else all.
    """
    named = materialise(groups.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "near-named")
    flips = minhash.most_flips(percent / 100)

    def compare(t: pa.Table) -> pa.RecordBatch:
        """The pairs of whole units, sorted by unit."""
        ids, comp, n, rest, side, unit, bucket = (t.column(c).to_numpy() for c in ("id", "component", "n", "rest", "side", "unit", "bucket"))
        odd, whole = (t.column(c).combine_chunks().flatten().to_numpy().reshape(len(ids), -1).view(np.uint64) for c in ("odd", "whole"))
        end = np.searchsorted(unit, unit, side="right")
        found, row = [], np.arange(len(ids))
        # All pairs at distance d in the order, for as many units at once as are so long.
        for d in range(1, len(ids)):
            row = row[row + d < end[row]]
            if not len(row):
                break
            i = row[(comp[row] != comp[row + d]) & ((side[row] == 0) | (side[row] != side[row + d])) & (bucket[row] == bucket[row + d])]
            found.append(_allowed_pairs(i, i + d, n, rest, whole, odd, percent, flips))
        i, j, z = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        if nearest:
            u, v, z = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([z, z])
            order = np.lexsort((ids[v], z, u))
            i, j = u[order], v[order]
            new = np.concatenate([[True], i[1:] != i[:-1]])[:len(i)]
            i, j = i[new], j[new]
        pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for b in released(batches):
            held.append(pa.Table.from_batches([b]))
            size += len(b)
            if size >= block:  # the last unit may go on
                t = pa.concat_tables(held)
                cut = int(np.searchsorted(t.column("unit").to_numpy(), t.column("unit")[-1].as_py()))
                if cut:
                    yield compare(t.slice(0, cut))
                held, size = [t.slice(cut)], size - cut
        if size:
            yield compare(pa.concat_tables(held))

    units = _units(named, block).join(open_.select("key", "n", "odd", "whole"), "key")
    dealt = units.repartition(partitions(groups.sparkSession), "unit").sortWithinPartitions("unit", "n")
    return dealt.select("unit", "bucket", "side", "id", "rest", "component", "n", "odd", "whole").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block: int = PART) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Links: ``100 * shared shingles >= percent * all shingles`` of two documents.
    """
    signed = materialise(sign(docs, words), "near-signed")
    linked = signed.filter("n > 0 and doc_id is not null")
    classes = linked.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    first = linked.join(classes, "set_key").filter("doc_id = id").dropDuplicates(["set_key"])
    first = first.select("id", "set_key", "n", "bands", "odd", "whole")
    keys = first.select("id", "set_key", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = keys.join(shared, "bucket").select("bucket", "least", "id", "set_key")
    buckets = materialise(members.join(first.select("id", "set_key", "n", "odd", "whole"), ["id", "set_key"]), "near-buckets")
    sets = materialise(_set_rows(docs, buckets.select("id", "set_key").distinct(), words), "near-sets")

    star = buckets.filter("id = least").select("bucket", F.col("id").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"), F.col("whole").alias("wa"))
    pairs = buckets.filter("id > least").join(star, "bucket").filter(
        _allowed(F.col("n"), F.col("na"), _flips("whole", "wa"), _flips("odd", "oa"), percent)).select("a", F.col("id").alias("b")).distinct()
    links = confirm(pairs, sets, percent)
    labels = materialise(components(links), "near-labels")
    open_ = _open_sets(buckets, labels, first, sets)
    if not open_.isEmpty():
        groups = rare_groups(open_, percent)
        for nearest in (True, False):
            pairs = materialise(_across(groups, open_, labels, percent, nearest, block), "near-across")
            if pairs.isEmpty():
                break
            more = confirm(screen(pairs, open_, percent), sets, percent)
            if not more.isEmpty():
                links = links.unionByName(more)
                labels = materialise(components(links), "near-labels")
    named = classes.join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("class_component"))
    whole = signed.select("doc_id", "set_key", "n").join(named, "set_key", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class_component")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id; all columns as they were."""
    (near_id,) = unused(docs, "near_id")
    gone = near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias(near_id)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(near_id), "left_anti")


def op8_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at 0.85 of their 3-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
