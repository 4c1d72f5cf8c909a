"""Byte-gram hashes, window minima and difference-cover suffix sorting (numpy part of the suffix dedup)."""

from __future__ import annotations

import numpy as np

from vigil.llm.words import mix

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place on, by joining hashes of power-of-two lengths."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, length = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    out, done, left = None, 0, size
    while True:
        if left & 1:
            part = block[done:done + n]
            out = part.copy() if out is None else out * np.uint64(pow(_BASE, length, 1 << 64)) + part
            done += length
        left >>= 1
        if not left:
            return mix(out)
        block = block[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + block[length:]
        length *= 2


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    done, out = 1, h
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _order_of(names: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names from 1 in the order of the keys, and how many."""
    order = np.argsort(names, kind="stable")
    sorted_ = names[order]
    dense = np.empty(len(names), np.int64)
    dense[order] = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return dense, int(dense.max())


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` (numbers from 1) in order, by the difference cover {1, 2} mod 3.

    Triples at the sampled places are sorted and named; if names repeat, the string of names
    is sorted in the same way. The other suffixes are sorted by their first number and the
    rank of the next, and merged by comparing one or two numbers and a sampled rank.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    p = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a place past the end if the last one is not sampled
    two = np.arange(2, n, 3)
    at = np.concatenate([one, two])
    size = int(p.max()) + 1
    if size < 1 << 21:
        names, count = _order_of((p[at] * size + p[at + 1]) * size + p[at + 2])
    else:
        high, _ = _order_of(p[at] * size + p[at + 1])
        names, count = _order_of(high * size + p[at + 2])
    if count == len(names):
        sampled = at[np.argsort(names, kind="stable")]
    else:
        sampled = at[suffix_order(names)]
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    wide = n + 3
    zero = np.arange(0, n, 3)
    key = p[zero] * wide + rank[zero + 1]
    zero = zero[np.argsort(key, kind="stable")]
    # How many sampled suffixes come before each of the others, by residue.
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(p[ones] * wide + rank[ones + 1], p[zero] * wide + rank[zero + 1])
    pairs, _ = _order_of(np.concatenate([p[twos] * size + p[twos + 1], p[zero] * size + p[zero + 1]]))
    before += np.searchsorted(pairs[:len(twos)] * wide + rank[twos + 2], pairs[len(twos):] * wide + rank[zero + 2])
    out = np.empty(len(sampled) + len(zero), np.int64)
    place = before + np.arange(len(zero))
    out[place] = zero
    rest = np.ones(len(out), bool)
    rest[place] = False
    out[rest] = sampled
    return out[out < n]


def same_as_next(data: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes at ``order[i]`` equal those at ``order[i + 1]`` (both inside ``data``)."""
    same = np.ones(max(len(order) - 1, 0), bool)
    live = np.arange(len(same))
    for k in range(size):
        live = live[data[order[live] + k] == data[order[live + 1] + k]]
    same[:] = False
    same[live] = True
    return same
