"""Exact substring dedup: bytes of 50-byte strings that also start in a document with a smaller id.

A sort of all suffixes of a corpus moves every byte many times, so the suffixes are first
dealt out so that only those that can be equal meet:

1. Documents are kept as compressed chunks (a stored table). In every chunk the 50-byte
   strings are grouped by the smallest hash of their 20-byte strings; a run of neighbours with the same one is
   one string of the text, ``run + 49`` bytes long. Equal 50-byte strings have equal smallest hashes.
2. The hashes, a few bytes each, are dealt by value; those of one document only are marked, and
   strings with a marked hash go no further (they cannot repeat).
3. The other strings, once per chunk, are dealt by their smallest hash. Each task sorts the
   suffixes of the different strings of a hash by the difference-cover method (triples at
   places 1 and 2 mod 3 sorted and named, recursion on names, merge of the rest; see
   ``grams.suffix_order``) and compares the first 50 bytes of neighbours. Each class of equal
   strings gets the smallest document that holds it.
   A string that is the only one of its hash is not sorted: its copies
   are those of equal hash and string id (two 64-bit hashes), bytes are not compared there.
4. Chunks meet the spans found for their strings; bytes are removed where that document is
   smaller than their own.

A passage in a third of all documents is one string per chunk when it is dealt out. A passage
shorter than 50 bytes in many surroundings is in many different strings with one smallest hash:
where these have more than ``HOT_BYTES`` bytes in all, step 2 names the hash, and its 50-byte
strings are dealt one by one, each by its own hash, so no task holds all of them. A collision
of the short hashes in step 2 only sends more strings to step 3.

Nulls: a null text is empty; a null id is neither smaller nor larger than any, so nothing is
removed there or because of it. Rows that repeat an id do not affect each other. Texts under 50
bytes stay. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import grams
from vigil.llm.common import materialise, out_batch, partitions, small_batches, table, text_or_empty
from vigil.llm.words import mix

LENGTH, GRAM = 50, 20
CHUNK_BYTES, SEGMENT, RUN = 4 << 20, 1 << 18, 1024
_BASE = 0xA24BAED4963EE407 | 1
_UP = np.cumprod(np.full(SEGMENT * 4 + LENGTH, _BASE, np.uint64))
_DOWN = np.cumprod(np.full(SEGMENT * 4 + LENGTH, pow(_BASE, -1, 1 << 64), np.uint64))
#: Bytes of the different strings of one smallest hash from which it is dealt by whole 50-byte strings, and the least such limit for each chunk.
HOT_BYTES, HOT_CHUNK = 1 << 20, 256
HIT = np.dtype([("sid", "<u8"), ("least", "<i8"), ("at", "<u2"), ("n", "<u2")])


# --- chunks -------------------------------------------------------------------------------

def chunk_table(docs: DataFrame) -> DataFrame:
    """``(chunk, ids, known, sizes, bytes)``: documents in chunks of about 4 MB, texts compressed (stored)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = [t.encode() for t in b.column("text").to_pylist()]
            ids, known = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            a = 0
            while a < len(texts):
                z, size = a + 1, len(texts[a])
                while z < len(texts) and size + len(texts[z]) <= CHUNK_BYTES:
                    size += len(texts[z])
                    z += 1
                cols = [ids[a:z].tobytes(), known[a:z].tobytes(), np.array([len(t) for t in texts[a:z]], np.int64).tobytes(), press.compress(b"".join(texts[a:z]))]
                yield out_batch(schema, [[0], *([c] for c in cols)])
                a = z

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    made = rows.mapInArrow(run, "chunk long, ids binary, known binary, sizes binary, bytes binary")
    return materialise(made.withColumn("chunk", F.monotonically_increasing_id()), "suffix-chunks")


class Chunk:
    """The documents of one chunk row."""

    def __init__(self, row: dict):
        import zstandard

        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
        self.starts = self.ends - np.frombuffer(row["sizes"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["bytes"]), np.uint8)

    def _segments(self) -> Iterator[tuple[int, int, int, int]]:
        """Byte ranges of whole documents, or of parts of a large one, with the range of documents."""
        a = 0
        while a < len(self.ends):
            z = a + 1
            while z < len(self.ends) and self.ends[z] - self.starts[a] <= SEGMENT:
                z += 1
            for s in range(int(self.starts[a]), max(int(self.ends[z - 1]) - LENGTH + 1, int(self.starts[a]) + 1), 2 * SEGMENT):
                yield s, min(s + 2 * SEGMENT + LENGTH - 1, int(self.ends[z - 1])), a, z
            a = z

    def runs(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``start, length, document, smallest hash, string id`` of the runs of 50-byte strings, in documents with ids.

        Under a hash in ``hot`` each 50-byte string is a run of its own.
        """
        out = [[], [], [], [], []]
        for s, e, a, z in self._segments():
            g = grams.gram_hashes(self.data[s:e], GRAM)
            if len(g) < LENGTH - GRAM + 1:
                continue
            least = grams.window_min(g, LENGTH - GRAM + 1)
            n = len(least)
            doc = np.repeat(np.arange(a, z), np.clip(self.ends[a:z], s, s + n) - np.clip(self.starts[a:z], s, s + n))
            whole = (np.arange(s, s + n) + LENGTH <= self.ends[doc]) & self.known[doc]
            new = np.ones(n, bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, n))
            first, size = first[whole[first]], size[whole[first]]
            if len(size) and size.max() > RUN:  # one letter over and over
                k = -(-size // RUN)
                at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                first, size = np.repeat(first, k) + at * RUN, np.minimum(np.repeat(size, k) - at * RUN, RUN)
            if len(hot):
                k = np.where(np.isin(least[first], hot), size, 1)
                at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                first, size = np.repeat(first, k) + at, np.repeat(size - k + 1, k)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * _DOWN[:len(g)])])
            sid = mix((total[first + size + LENGTH - GRAM] - total[first]) * _UP[first] + size.astype(np.uint64))
            for o, v in zip(out, (first + s, size, doc[first], least[first], sid)):
                o.append(v)
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        return tuple(np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds))


def _keys(least: np.ndarray, sid: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What strings are dealt and grouped by: their smallest hash, or, under a hot one, all of the string."""
    return np.where(np.isin(least, hot), sid ^ mix(least), least) if len(hot) else least


_NONE = np.zeros(0, np.uint64)
_HEAVY = np.dtype([("least", "<u8"), ("bytes", "<i8")])


def _heavy(number: np.ndarray, least: np.ndarray, sid: np.ndarray, size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hashes whose different strings have ``limit`` bytes or more in a chunk: their numbers, ascending, and ``_HEAVY``."""
    large = np.bincount(number, size) >= limit if len(number) else np.zeros(0, bool)
    at = np.flatnonzero(large[number])
    at = at[np.lexsort((sid[at], number[at]))]
    at = at[np.concatenate([[True], (sid[at][1:] != sid[at][:-1]) | (number[at][1:] != number[at][:-1])])[:len(at)]]
    first = np.flatnonzero(np.concatenate([[True], number[at][1:] != number[at][:-1]])[:len(at)])
    out = np.zeros(len(first), _HEAVY)
    if len(first):
        out["least"], out["bytes"] = least[at[first]], np.add.reduceat(size[at], first)
    keep = out["bytes"] >= limit
    return number[at[first]][keep], out[keep]


def _values(least: np.ndarray, doc_ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different smallest hashes of a chunk by (bucket, short hash): run -> number, several documents, bucket, short hash."""
    value, number = np.unique(mix(least), return_inverse=True)
    low, high = np.full(len(value), np.iinfo(np.int64).max), np.full(len(value), np.iinfo(np.int64).min)
    np.minimum.at(low, number, doc_ids)
    np.maximum.at(high, number, doc_ids)
    bucket, short = (value % np.uint64(n)).astype(np.int32), (value >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((short, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[number], (low != high)[order], bucket[order], short[order]


# --- the screen ---------------------------------------------------------------------------

def _press(short: np.ndarray) -> bytes:
    """Sorted uint32 as compressed differences, byte plane by byte plane."""
    import zstandard

    steps = np.diff(short, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpress(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def repeated_hashes(chunks: DataFrame, n: int, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, np.ndarray]:
    """``(chunk, masks)``: for each bucket of a chunk, which of its hashes occur in another chunk (stored); and the hot hashes.

    Every hash whose different strings, counted once a chunk, have ``hot_bytes`` or more is hot; the
    chunks name it where it has half its share, so half of the bytes are counted at least. The driver
    gets 8 bytes for each hot hash, of which there is at most one in ``hot_bytes / 2`` bytes of strings.
    """
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("shorts", pa.binary()), ("heavy", pa.binary())])
    many = max(chunks.count(), 1)
    hot_bytes = max(hot_bytes, HOT_CHUNK * many) if hot_bytes > 1 else hot_bytes
    share = max(hot_bytes // (2 * many), 1)

    def emit(batches):
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                _, size, doc, least, sid = c.runs(_NONE)
                number, _, bucket, short = _values(least, c.ids[doc], n)
                at, heavy = _heavy(number, least, sid, size + LENGTH - 1, share)
                cuts = np.searchsorted(bucket, np.arange(n + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield out_batch(schema, [full, np.full(len(full), row["chunk"]), [_press(short[cuts[k]:cuts[k + 1]]) for k in full],
                                         [heavy[slice(*np.searchsorted(at, cuts[k:k + 2]))].tobytes() for k in full]])

    def meet(t: pa.Table) -> pa.Table:
        lists = [_unpress(x) for x in t.column("shorts").to_pylist()]
        flat = np.concatenate(lists)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        twice = np.zeros(len(flat), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        masks = [np.packbits(twice[a:z]).tobytes() for a, z in zip(cuts, cuts[1:])]
        heavy = np.frombuffer(b"".join(t.column("heavy").to_pylist()), _HEAVY)
        least, of = np.unique(heavy["least"], return_inverse=True)
        hot = least[np.bincount(of, heavy["bytes"], len(least)) >= hot_bytes / 2].tobytes()
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "n": pa.array(np.diff(cuts), pa.int32()), "mask": pa.array(masks, pa.binary()),
                         "hot": pa.array([hot] + [b""] * (len(lists) - 1), pa.binary())})

    dealt = chunks.mapInArrow(emit, "bucket int, chunk long, shorts binary, heavy binary")
    met = materialise(dealt.groupBy("bucket").applyInArrow(meet, "chunk long, bucket int, n int, mask binary, hot binary"), "suffix-masks")
    hot = np.frombuffer(b"".join(bytes(r.hot) for r in met.select("hot").filter(F.octet_length("hot") > 0).collect()), np.uint64)
    return met.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "mask"))).alias("masks")), np.sort(hot)


# --- strings and their suffixes -----------------------------------------------------------

PACKED = "bucket int, chunk long, strings binary"
#: What is kept of a string beside its bytes: their number, and the smallest and largest document that hold it.
HEAD = np.dtype([("size", "<u2"), ("low", "<i8"), ("high", "<i8")])


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several stretches, one after another."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at))
    return data[at]


def repeatable_strings(screened: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """``PACKED``: the different strings of each chunk that may repeat, by bucket of their key, compressed."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("strings", pa.binary())])

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                start, size, doc, least, sid = c.runs(hot)
                number, several, bucket, _ = _values(least, c.ids[doc], n)
                bucket = (mix(_keys(least, sid, hot)) % np.uint64(n)).astype(np.int32) if len(hot) else bucket[number]
                marked = several
                if row["masks"] is not None:
                    bits = [np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["n"]).astype(bool) for m in row["masks"]]
                    marked = several | np.concatenate(bits)
                keep = np.flatnonzero(marked[number]) if len(number) else np.zeros(0, np.int64)
                if not len(keep):
                    continue
                keep = keep[np.lexsort((sid[keep], bucket[keep]))]
                first = np.flatnonzero(np.concatenate([[True], sid[keep][1:] != sid[keep][:-1]]))
                ids = c.ids[doc[keep]]
                head = np.zeros(len(first), HEAD)
                head["low"], head["high"] = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
                keep = keep[first]
                head["size"] = size[keep] + LENGTH - 1
                of = bucket[keep]
                cuts = np.searchsorted(of, np.arange(n + 1))
                full = np.flatnonzero(np.diff(cuts))
                packed = []
                for a, z in zip(cuts[full], cuts[full + 1]):
                    planes = head[a:z].view(np.uint8).reshape(z - a, -1).T.tobytes()
                    text = _gather(c.data, start[keep[a:z]], head["size"][a:z].astype(np.int64)).tobytes()
                    packed.append(press.compress(np.int64(z - a).tobytes() + planes + text))
                yield out_batch(schema, [full, np.full(len(full), row["chunk"]), packed])

    return screened.mapInArrow(run, PACKED)


def _unpack(packed: bytes, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Heads, bytes, keys and string ids of a packed bucket; the hashes are computed from the bytes."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head = np.ascontiguousarray(raw[8:8 + n * HEAD.itemsize].reshape(HEAD.itemsize, n).T).view(HEAD).ravel()
    data, size = raw[8 + n * HEAD.itemsize:], head["size"].astype(np.int64)
    ends = np.cumsum(size)
    least, sid = np.empty(n, np.uint64), np.empty(n, np.uint64)
    a = 0
    while a < n:  # as many strings as the tables of powers reach
        z = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + len(_UP) - LENGTH, side="right")))
        begin = ends[a] - size[a]
        g = grams.gram_hashes(data[begin:ends[z - 1]], GRAM)
        first = ends[a:z] - size[a:z] - begin
        last = first + size[a:z] - GRAM + 1  # of the grams of a string
        bounds = np.stack([first, np.minimum(last, len(g) - 1)], 1).ravel()
        low = np.minimum.reduceat(g, bounds)[::2]
        low[-1] = g[first[-1]:].min()
        least[a:z] = low
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * _DOWN[:len(g)])])
        sid[a:z] = mix((total[last] - total[first]) * _UP[first] + (size[a:z] - LENGTH + 1).astype(np.uint64))
        a = z
    return head, data, _keys(least, sid, hot), sid


def _spans(least: np.ndarray, low: np.ndarray, size: np.ndarray, start: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """``string, at, n, smallest document`` of the runs of 50-byte strings in different strings, sorted by ``least``."""
    same = least[1:] == least[:-1]
    alone = np.ones(len(least), bool)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    one, many = np.flatnonzero(alone), np.flatnonzero(~alone)
    out = [(one, np.zeros(len(one), np.int64), size[one] - LENGTH + 1, low[one])]
    if len(many):
        text, length = _gather(data, start[many], size[many]), size[many]
        ends = np.cumsum(length)
        order = grams.suffix_order(text.astype(np.int64) + 1)
        owner = np.repeat(np.arange(len(many)), length)
        order = order[order + LENGTH <= ends[owner[order]]]
        group = np.concatenate([[0], np.cumsum(~grams.same_as_next(text, order, LENGTH))])
        best = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, group, low[many][owner[order]])
        at = np.full(len(text), -1, np.int64)
        at[order] = group
        places = np.flatnonzero(at >= 0)
        value, own = best[at[places]], owner[places]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])]))
        offset = places - (ends - length)[own]
        out.append((many[own[first]], offset[first], np.diff(np.append(first, len(places))), value[first]))
    cols = [np.concatenate(c) for c in zip(*out)]
    order = np.argsort(cols[0], kind="stable")
    return tuple(c[order] for c in cols)


#: Bytes of strings whose suffixes are sorted together.
SLAB = 1 << 20


def removable(strings: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """``(chunk, hits)``: for each chunk, its strings' spans that a smaller document holds."""
    schema = pa.schema([("chunk", pa.int64()), ("hits", pa.binary())])

    def bucket_hits(rows: list[tuple[int, bytes]]):
        parts = [(chunk, *_unpack(packed, hot)) for chunk, packed in rows]
        chunk = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        head, data, least, sid = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
        size = head["size"].astype(np.int64)
        start = np.cumsum(size) - size
        order = np.lexsort((sid, least))
        new = np.concatenate([[True], (least[order][1:] != least[order][:-1]) | (sid[order][1:] != sid[order][:-1])])
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1  # of the different string, for each row in order
        low = np.minimum.reduceat(head["low"][order], first)
        lead = order[first]
        # Slabs of whole hashes.
        bounds = np.flatnonzero(np.concatenate([[True], least[lead][1:] != least[lead][:-1]]))
        filled = np.cumsum(size[lead])
        cuts, a = [0], 0
        for z in np.append(bounds[1:], len(lead)):
            if filled[z - 1] - (filled[a - 1] if a else 0) >= SLAB:
                cuts.append(int(z))
                a = int(z)
        if cuts[-1] != len(lead):
            cuts.append(len(lead))
        spans = []
        for a, z in zip(cuts, cuts[1:]):
            own, at, m, value = _spans(least[lead[a:z]], low[a:z], size[lead[a:z]], start[lead[a:z]], data)
            spans.append((own + a, at, m, value))
        own, at, m, value = (np.concatenate(c) for c in zip(*spans))
        count = np.bincount(own, minlength=len(lead))
        each = count[number]
        row = np.repeat(order, each)
        span = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + np.repeat((np.cumsum(count) - count)[number], each)
        keep = value[span] < head["high"][row]
        row, span = row[keep], span[keep]
        hits = np.zeros(len(row), HIT)
        hits["sid"], hits["least"], hits["at"], hits["n"] = sid[row], value[span], at[span], m[span]
        by = np.argsort(chunk[row], kind="stable")
        hits, of = hits[by], chunk[row][by]
        ends = np.flatnonzero(np.concatenate([of[1:] != of[:-1], [True]])) + 1 if len(of) else np.zeros(0, np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)[:len(ends)]
        return out_batch(schema, [of[begins], [hits[a:z].tobytes() for a, z in zip(begins, ends)]])

    def run(batches):
        now, rows = None, []
        for b in batches:
            for bucket, chunk, packed in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "strings"))):
                if bucket != now and rows:
                    yield bucket_hits(rows)
                    rows = []
                now = bucket
                rows.append((chunk, packed))
        if rows:
            yield bucket_hits(rows)

    dealt = strings.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(run, "chunk long, hits binary").groupBy("chunk").agg(F.collect_list("hits").alias("hits"))


def removed_bytes(c: Chunk, hits: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk go."""
    cover = np.zeros(len(c.data) + 1, np.int32)
    start, _, doc, _, sid = c.runs(hot)
    hits = hits[np.argsort(hits["sid"], kind="stable")]
    a, z = np.searchsorted(hits["sid"], sid), np.searchsorted(hits["sid"], sid, side="right")
    run = np.repeat(np.arange(len(sid)), z - a)
    h = hits[np.arange(len(run)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + a[run]]
    keep = h["least"] < c.ids[doc[run]]
    begin = start[run[keep]] + h["at"][keep]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + h["n"][keep] + LENGTH - 1, -1)
    return np.cumsum(cover[:-1]) > 0


ROWS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_substrings(docs: DataFrame, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Chunks with the spans to remove: ``(chunk, ids, known, sizes, bytes, hits, hot)``, and the chunk table."""
    chunks = chunk_table(docs)
    n = partitions(docs.sparkSession)
    masks, hot = repeated_hashes(chunks, n, hot_bytes)
    screened = chunks.join(masks.hint("shuffle_hash"), "chunk", "left")
    hits = removable(repeatable_strings(screened, n, hot), n, hot)
    return chunks.join(hits.hint("shuffle_hash"), "chunk", "left").withColumn("hot", F.lit(bytearray(hot.tobytes()))), chunks


def _results(batches):
    for b in batches:
        for row in b.to_pylist():
            c = Chunk(row)
            gone = removed_bytes(c, np.concatenate([np.frombuffer(h, HIT) for h in row["hits"]]), np.frombuffer(row["hot"], np.uint64)) if row["hits"] else np.zeros(len(c.data), bool)
            yield c, gone


def report(found: DataFrame) -> DataFrame:
    """``ROWS``: what is removed from each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for c, gone in _results(batches):
            rows = []
            for i, (a, z) in enumerate(zip(c.starts, c.ends)):
                g = gone[a:z]
                spans = int((g[1:] & ~g[:-1]).sum() + g[0]) if z > a else 0
                rows.append((z - a, g.sum(), spans, hashlib.sha256(c.data[a:z][~g].tobytes()).hexdigest()))
            yield out_batch(schema, [pa.array(c.ids, mask=~c.known), *zip(*rows)])

    return found.mapInArrow(run, ROWS)


def remaining(found: DataFrame) -> DataFrame:
    """``(doc_id, kept)``: the bytes left of each document (cuts may fall inside a code point)."""
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for c, gone in _results(batches):
            kept = [c.data[a:z][~gone[a:z]].tobytes() for a, z in zip(c.starts, c.ends)]
            yield out_batch(schema, [pa.array(c.ids, mask=~c.known), kept])

    return found.mapInArrow(run, "doc_id long, kept binary")


def op5_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50-byte repeats of smaller documents remove from each document."""
    return report(dedup_substrings(table(spark, sf_dir, "documents"))[0])
