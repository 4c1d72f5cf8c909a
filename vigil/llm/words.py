"""64-bit hashes of the words of many texts, by Arrow and numpy."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_NOT_WORD = re.compile(r"[\W_]+")
_MIX = np.uint64(0xD6E8FEB86659FD93)


def alnum(word: str) -> str:
    """Lower case, letters and digits only; may be empty."""
    return _NOT_WORD.sub("", word.lower())


def same(word: str) -> str:
    return word


def word_hashes(texts: list[str], norm: Callable[[str], str] = same, ascii_lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, bounds, place)`` of the words, cut at the six ASCII white-space characters.

    Words that ``norm`` makes empty are left out; ``place`` is the number of the word in its
    text before that. Text i has ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    array = pa.array(texts, pa.large_string())
    cut = pc.ascii_split_whitespace(pc.ascii_lower(array) if ascii_lower else array)
    flat, offsets = cut.flatten(), cut.offsets.to_numpy()
    numbered = flat.dictionary_encode()
    words = [norm(w) for w in numbered.dictionary.to_pylist()]
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    number = numbered.indices.to_numpy()
    # Arrow gives empty pieces at the ends of a text; they are no words.
    real = (pc.binary_length(flat).to_numpy() > 0)
    full = np.fromiter((bool(w) for w in words), bool, len(words))[number] & real
    before = np.cumsum(real) - real
    place = before - np.repeat(before[np.minimum(offsets[:-1], max(len(before) - 1, 0))] if len(before) else before, np.diff(offsets))
    return known[number[full]], np.concatenate([[0], np.cumsum(full)])[offsets], place[full]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(hashes: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Hashes of the words at ``i + o`` for o in ``offsets``, for every i that has them (text borders are not looked at)."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for o in offsets:
        out = mix(out + hashes[o:o + n] + np.uint64(0x9E3779B97F4A7C15))
    return out
