"""Exact byte-level BPE of many texts with a store of pieces.

The pre-tokenizer of a byte-level BPE never joins a character with a space that follows it,
and a single space between two other characters always opens the next pre-token. So a text
may be cut in front of every such space and the pieces encoded alone: their ids, joined,
are those of the whole text. Likewise a mark such as a comma after a letter opens a
pre-token. Arrow cuts the texts, numbers the pieces and looks them up; only pieces not in
the store go to the tokenizer, several in one string, parted by tabs: a tab between
characters that are not white space, or before a single space, is a pre-token of its own.

The library looks for added tokens (such as ``<|endoftext|>``) before all this, so a text that
holds the content of one is not cut: it goes to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vigil.llm.common import release_memory, slabs

_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Empty, or white space at an end: the space it was cut at stood beside other white space.
_ODD = f"^$|^{_SPACE}|{_SPACE}$"
#: A letter (plain or Latin with marks) and one mark at the end.
_MARKED = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}][,.;:!?]$"
_MARKS = ",.;:!?"
#: Pieces in one string, and characters in one call of the tokenizer: what the library and Python hold for a token takes over a hundred bytes.
_JOINED, _CALL_CHARS = 64, 200_000
_NOTHING, _BLANK = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


class PieceEncoder:
    """``encode(texts, end_id)`` gives the ids of all texts, each closed by ``end_id``, and their offsets.

    Ids equal ``Tokenizer.encode(text, add_special_tokens=False)`` of the library with the file as it
    is; a text that holds the content of an added token gets that token's id. When more than
    ``cache`` pieces are stored, the half that was seen most often stays.
    """

    def __init__(self, path: str, cache: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.cache = cache
        (self.tab,) = self.tok.encode("\t", add_special_tokens=False).ids
        # Piece 0 is the end id, then the marks; pieces of the store begin with a space.
        self.keys = pa.array(["\n", *_MARKS], pa.large_string())
        ids, self.lens = self._tokens(list(_MARKS))
        self.flat, self.lens = np.concatenate([[np.uint32(0)], ids]), np.concatenate([[1], self.lens])
        self.seen = np.full(len(self.lens), 1 << 60)

    def _tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in slabs(list(map(len, pieces)), _CALL_CHARS):
            ids_of = [e.ids for e in self.tok.encode_batch_fast(pieces[a:b], add_special_tokens=False)]
            lens.append(np.fromiter(map(len, ids_of), np.int64, b - a))
            ids.append(np.fromiter(chain.from_iterable(ids_of), np.uint32, int(lens[-1].sum())))
        return np.concatenate(ids), np.concatenate(lens)

    def _joined_tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_tokens``, for pieces without tabs and without white space at the end; many are one string to the tokenizer."""
        ids, _ = self._tokens(["\t".join([*pieces[a:a + _JOINED], ""]) for a in range(0, len(pieces), _JOINED)])
        tabs = np.flatnonzero(ids == self.tab)
        return ids[ids != self.tab], np.diff(tabs, prepend=-1) - 1

    @staticmethod
    def _join(at: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of pieces, and where each ends."""
        starts, n = np.cumsum(lens) - lens, lens[at]
        ends = np.cumsum(n)
        gather = np.repeat((starts[at] - (ends - n)).astype(np.int32), n)  # stores and slabs have far less than 2^31 ids
        gather += np.arange(len(gather), dtype=np.int32)
        return flat[gather], ends

    def _store(self, keys: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.flat, self.lens = np.concatenate([self.flat, ids]), np.concatenate([self.lens, lens])
        self.seen = np.concatenate([self.seen, np.zeros(len(lens), np.int64)])

    def _find(self, pieces: pa.Array) -> np.ndarray:
        return pc.index_in(pieces, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)

    def _learn(self, pieces: pa.Array, marked: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Store different pieces, none of them stored yet; their numbers. ``at``: numbers of the ``marked`` ones without their marks, -1 if not stored."""
        tabs = pc.match_substring(pieces, "\t").to_numpy(zero_copy_only=False)
        marked, at = marked & ~tabs, at[~tabs[marked]]
        out = np.empty(len(pieces), np.int64)
        out[tabs] = len(self.lens) + np.arange(tabs.sum())
        self._store(pieces.filter(pa.array(tabs)), *self._tokens(pieces.filter(pa.array(tabs)).to_pylist()))
        # A letter and a mark at the end: the piece without the mark may be known or among the others.
        ends = pieces.filter(pa.array(marked))
        cores = pc.utf8_slice_codeunits(ends, 0, -1)
        plain = pc.unique(pa.concat_arrays([pieces.filter(pa.array(~marked & ~tabs)), cores.filter(pa.array(at < 0))]))
        first = len(self.lens)
        self._store(plain, *self._joined_tokens(plain.to_pylist()))
        at[at < 0] = first + pc.index_in(cores.filter(pa.array(at < 0)), value_set=plain).to_numpy()
        out[~marked & ~tabs] = first + np.arange((~marked & ~tabs).sum())
        out[marked] = len(self.lens) + np.arange(len(ends))
        mark = 1 + pc.index_in(pc.utf8_slice_codeunits(ends, -1), value_set=self.keys.slice(1, len(_MARKS))).to_numpy().astype(np.int64)
        ids, last = self._join(np.stack([at, mark], 1).ravel(), self.flat, self.lens)
        self._store(ends, ids, np.diff(last[1::2], prepend=0))
        return out

    def _shrink(self) -> None:
        if len(self.lens) > self.cache:
            keep = np.sort(np.argsort(-self.seen, kind="stable")[:self.cache // 2 + 1 + len(_MARKS)])
            self.flat, _ = self._join(keep, self.flat, self.lens)
            self.keys, self.lens, self.seen = self.keys.take(pa.array(keep)), self.lens[keep], self.seen[keep] >> 1
            self.seen[:1 + len(_MARKS)] = 1 << 60

    def _holds_added(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold the content of an added token."""
        out = np.zeros(len(texts), bool)
        for content in self.added:
            out |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        return out

    def _slab(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        self._shrink()
        self.flat[0] = end_id
        cut = pc.split_pattern(texts, " ")
        numbered = cut.flatten().dictionary_encode()
        bounds, number, unique = cut.offsets.to_numpy(), numbered.indices.to_numpy(), numbered.dictionary
        odd = pc.match_substring_regex(unique, _ODD).to_numpy(zero_copy_only=False)
        uncut = self._holds_added(texts)
        if uncut.any():
            odd |= self._holds_added(unique)  # not to be stored
        spaced = pc.binary_join_element_wise(_NOTHING, unique, _BLANK)
        # One look into the store, which costs a pass over it: for the pieces, and for those with a mark at the end without it.
        marked = pc.match_substring_regex(spaced, _MARKED).to_numpy(zero_copy_only=False)
        found = self._find(pa.concat_arrays([spaced, pc.utf8_slice_codeunits(spaced.filter(pa.array(marked)), 0, -1)]))
        at_of, core_of = found[:len(spaced)], found[len(spaced):]
        fresh = (at_of < 0) & ~odd
        if fresh.any():
            at_of[fresh] = self._learn(spaced.filter(pa.array(fresh)), marked[fresh], core_of[fresh[marked]])
        self.seen[at_of[at_of >= 0]] += 1
        at, odd = at_of[number], (np.add.reduceat(odd[number].astype(np.int64), bounds[:-1]) > 0) | uncut
        # First pieces have no space before them, texts with a space beside other white space
        # are cut with care, and those with an added token not at all: these pieces are not stored.
        heads = unique.take(pa.array(number[bounds[:-1]])).to_pylist()
        own = [([texts[i].as_py()] if u else _SAFE_CUT.split(texts[i].as_py())) if o else [h]
               for i, (o, u, h) in enumerate(zip(odd.tolist(), uncut.tolist(), heads))]
        raw = list(dict.fromkeys(chain.from_iterable(own)))
        number_of = dict(zip(raw, range(len(self.lens), len(self.lens) + len(raw))))
        parts, end = [], np.zeros(1, np.int64)
        for i, pieces in enumerate(own):
            parts += [np.fromiter((number_of[p] for p in pieces), np.int64, len(pieces)), end if odd[i] else at[bounds[i] + 1:bounds[i + 1]]]
            if not odd[i]:
                parts.append(end)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ids, lens = self._tokens(raw)
        ids, ends = self._join(np.concatenate(parts), np.concatenate([self.flat, ids]), np.concatenate([self.lens, lens]))
        last = np.cumsum(sizes)[np.cumsum(np.where(odd, 2, 3)) - 1]
        return ids, ends[last - 1]

    def encode(self, texts: pa.Array | list[str], end_id: int, slab: int = 6_000_000) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` (uint32) of all texts and ``offsets`` (n + 1): text i has ``ids[offsets[i]:offsets[i + 1]]``.

        ``slab``: bytes of text handled at once; larger ones look fewer pieces up and take more memory.
        """
        texts = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()))
        ids, offsets, total = [], [np.zeros(1, np.int64)], 0
        for a, b in slabs(pc.binary_length(texts).to_pylist(), slab):
            got, ends = self._slab(texts[a:b], end_id)
            release_memory()  # else Arrow and malloc keep what the slab has used
            ids.append(got)
            offsets.append(ends + total)
            total += len(got)
        return (ids[0] if len(ids) == 1 else np.concatenate([np.zeros(0, np.uint32), *ids])), np.concatenate(offsets)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, cache: int = 500_000) -> PieceEncoder:
    """One encoder per Python worker and file; workers are reused, so the store outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, cache)
    _ENCODERS[path].cache = cache
    return _ENCODERS[path]
