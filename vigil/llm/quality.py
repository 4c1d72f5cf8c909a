"""Quality rules: statistics of whole documents, base limits, and gradient-boosted trees over the statistics.

Trees are fitted on the driver to a bounded sample of labelled documents (``SAMPLE_ROWS``,
those with the smallest hash of the id), as flat numpy arrays of nodes (feature, threshold,
children, value), so that scoring a batch is ``depth`` gathers a tree. Splits on the
features named in ``MONOTONE`` that would break the given direction are refused, and the
bounds of a split hold for all below it. Statistics and scores cover every document.

Nulls: a null text has no words, so it fails the base limits. Empty texts likewise. A null
label row, a null id in the labels, or labels without documents are left out of the fit; with
labels of one kind only, or none, the verdict is that of the base limits. Repeated documents
are judged one by one; an empty table gives no rows. Other columns pass through
``filter_documents`` and are ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import ASCII_SPACE, out_batch, released, slabs, small_batches, table, text_or_empty

SAMPLE_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "line_words", "long_words"]
#: +1: the verdict may only get better with the feature, -1: only worse.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[128:192] = 1  # inside a code point
    kind[list(ASCII_SPACE.encode())] = 2
    kind[list(SYMBOLS.encode())] = 3
    kind[65:91] = 4
    kind[48:58] = 5
    kind[list(b"!?.,;:\"'()-_=/\\[]{}^~`@+")] = 6
    return kind


_CLASS = _classes()


def _dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(ASCII_SPACE)]
    return len(lines) - len(set(lines))


def _repeat_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each document that lie in a window of 5 found at least twice in it.

    Windows are compared by 64-bit hashes of (document, exact word numbers).
    """
    n, docs = len(codes), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cover = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        key = docs[:n - WINDOW + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(WINDOW):
            key = (key ^ (codes[k:n - WINDOW + 1 + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        inside = np.flatnonzero(docs[:n - WINDOW + 1] == docs[WINDOW - 1:])
        key = key[inside]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        starts = inside[twice]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:n]) > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


def statistics(texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base statistics (``BASE``) and the feature matrix of a list of texts."""
    stats = {k: np.zeros(len(texts), np.int64) for k in BASE}
    x = np.zeros((len(texts), len(FEATURES)), np.float32)
    for a, b in slabs([len(t) for t in texts]):
        part = texts[a:b]
        array = pa.array(part, pa.large_string()).cast(pa.large_binary())
        words = pc.ascii_split_whitespace(array.cast(pa.large_string()))
        flat, cuts = words.flatten(), words.offsets.to_numpy()
        size = pc.binary_length(flat).to_numpy()
        full = size > 0
        bounds = np.concatenate([[0], np.cumsum(full)])[cuts]
        codes = flat.dictionary_encode().indices.to_numpy()[full]
        raw = "".join(part).encode()
        at = np.concatenate([[0], np.cumsum(pc.binary_length(array).to_numpy())])
        kind = _CLASS[np.frombuffer(raw, np.uint8)]
        counts = np.zeros((7, len(part)), np.int64)
        for k in range(7):
            run = np.concatenate([[0], np.cumsum(kind == k)])
            counts[k] = run[at[1:]] - run[at[:-1]]
        n_words = np.diff(bounds)
        chars = counts.sum(0) - counts[1] - counts[2]
        lines = np.array([t.count("\n") + 1 for t in part])
        big = np.concatenate([[0], np.cumsum((size > 20)[full])])
        s = {"n_words": n_words, "word_chars": chars, "n_symbols": counts[3],
             "n_dup_lines": np.array([_dup_lines(t) for t in part]), "n_repeat_words": _repeat_words(codes, bounds)}
        for k, v in s.items():
            stats[k][a:b] = v
        w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
        x[a:b] = np.stack([np.log1p(n_words), chars / w, counts[3] / w, s["n_dup_lines"] / lines, s["n_repeat_words"] / w, counts[4] / c,
                           counts[5] / c, counts[6] / w, n_words / lines, (big[bounds[1:]] - big[bounds[:-1]]) / w], 1)
    return stats, x


@dataclass
class Trees:
    """Flat nodes of all trees; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality, one per row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 5,
        penalty: float = 1.0, monotone: dict[str, int] | None = None) -> Trees | None:
    """Boost depth-limited trees on log loss over quantile bins; None without both labels."""
    if len(y) == 0 or y.min() == y.max():
        return None
    sign = [(MONOTONE if monotone is None else monotone).get(f, 0) for f in FEATURES]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    nodes: list[list[float]] = []
    roots, score = [], np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        own = float(np.clip(g[rows].sum() / (h[rows].sum() + penalty), low, high))
        nodes.append([0, np.inf, me, me, rate * own])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            gt, ht = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(e) + 1))[:-1]
                vl, vr = np.clip(gl / (hl + penalty), low, high), np.clip((gt - gl) / (ht - hl + penalty), low, high)
                gain = gl ** 2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt ** 2 / (ht + penalty)
                gain[(nl < least) | (len(rows) - nl < least) | (sign[j] * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            score[rows] += rate * own
            return me
        j, k, vl, vr = best[1]
        goes, middle = binned[rows, j] <= k, (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(sign[j], ((low, high), (low, high)))
        nodes[me][:2] = [j, float(edges[j][k])]
        nodes[me][2] = grow(rows[goes], g, h, level + 1, *bounds[0])
        nodes[me][3] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), 0, -np.inf, np.inf))
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1].astype(np.float32), flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64),
                 flat[:, 4], np.array(roots), depth, base)


def labelled_features(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample: the ``rows`` labels with the smallest hash of the id."""
    small_batches(docs.sparkSession)
    sample = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")  # at most ``rows`` rows

    def features(batches):
        for b in released(batches):
            _, x = statistics(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int32()), pa.array(x.tolist(), pa.list_(pa.float32()))],
                                             names=["doc_id", "quality", "x"])

    got = found.mapInArrow(features, "doc_id long, quality int, x array<float>").orderBy(F.xxhash64("doc_id"), "x").limit(rows).collect()
    return np.array([r.x for r in got], np.float32).reshape(-1, len(FEATURES)), np.array([r.quality for r in got], float)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees | None:
    return fit(*labelled_features(docs, labels, rows))


def judge(stats: dict[str, np.ndarray], x: np.ndarray, model: Trees | None, cut: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base_failed``, ``score`` (log odds) and ``kept``: base passed and score at least ``cut``."""
    failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])
    score = model.score(x) if model else np.zeros(len(x))
    return failed, score, ~failed & (score >= cut)


def score_documents(docs: DataFrame, model: Trees | None, cut: float = 0.0) -> DataFrame:
    """One row per document: id, base statistics, ``base_failed``, ``score``, ``kept``."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    types = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in BASE] + [("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        for b in released(batches):
            stats, x = statistics(b.column("text").to_pylist())
            yield out_batch(types, [b.column("doc_id"), *(stats[c] for c in BASE), *judge(stats, x, model, cut)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, model: Trees | None, cut: float = 0.0) -> DataFrame:
    """The documents kept, all columns as they were; scored where they are read, nothing is shuffled."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in released(batches):
            stats, x = statistics(["" if t is None else t for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(judge(stats, x, model, cut)[2]))

    return docs.mapInArrow(run, docs.schema)


def op6_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; trees fitted to the table of labels."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
