"""MinHash signatures and odd sketches of shingle sets (numpy part)."""

from __future__ import annotations

import numpy as np
import xxhash

from vigil.llm.common import slabs
from vigil.llm.words import gram_hashes, mix, word_hashes

#: 32 bands of 5 samples: a pair at similarity 0.85 shares no band with probability 7e-9, at 0.8 with 3e-6.
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
#: Bits of the odd sketch of the samples, and of the odd sketch of the whole set.
SKETCH_BITS, SET_BITS = 512, 1024
_MUL = (np.random.default_rng(20240229).integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = np.random.default_rng(20240301).integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of each text (A-Z lowered).

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    out: list[np.ndarray] = []
    for a, b in slabs([len(t) for t in texts]):
        h, bounds, _ = word_hashes(texts[a:b], ascii_lower=True)
        grams = gram_hashes(h, list(range(words)))
        for s, e in zip(bounds, bounds[1:]):
            n = e - s
            if n >= words:
                out.append(np.unique(grams[s:e - words + 1]))
            else:
                out.append(np.array([xxhash.xxh64_intdigest(h[s:e].tobytes(), 1)], np.uint64) if n else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima of random linear maps of the (already mixed) shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        y = x[None, a:a + 2048] * _MUL
        y += _ADD
        np.minimum(least, y.min(1), out=least)
    return least


_AT = np.arange(SAMPLES, dtype=np.uint64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key + rows[:, k])
    return key.view(np.int64)


def _parity(bit: np.ndarray, size: int) -> np.ndarray:
    odd = np.bincount(bit.astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: ``SKETCH_BITS`` bits as int64 words.

    Each (sample number, value) flips one bit, so the XOR of two sketches is the sketch of the
    samples in which the two sets differ.
    """
    return _parity(mix((_AT << np.uint64(32)) + sig) % np.uint64(SKETCH_BITS), SKETCH_BITS)


def set_sketch(shingles: np.ndarray, bits: int = SET_BITS) -> np.ndarray:
    """Parity bitmap of the whole set: the XOR of two has at most as many bits as the sets have differing members.

    The XOR of the halves of one of ``2 * bits`` bits is the one of ``bits`` bits (powers of two).
    """
    return _parity(shingles % np.uint64(bits), bits)


def most_flips(similarity: float, slack: float = 0.2) -> int:
    """XOR bits of two odd sketches beyond which a similarity of at least ``similarity`` is out of the question.

    With m samples and n bits the estimate from z flipped bits is 1 + n / (4 m) ln(1 - 2 z / n); its standard
    error near 0.8 is 0.03, and ``slack`` is over six of it.
    """
    left = np.exp((similarity - slack - 1) * 4 * SAMPLES / SKETCH_BITS)
    return int(np.ceil(SKETCH_BITS * (1 - left) / 2))
