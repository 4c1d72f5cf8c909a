"""Python workers live through all stages: they hold little at once and give freed memory back."""

import pyarrow as pa
import public_tokenizers
import pytest

from vigil.llm import bpe, common

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


class _Counting:
    """The tokenizer, noting the characters of each call."""

    def __init__(self, tok):
        self.tok, self.calls = tok, []

    def __getattr__(self, name):
        return getattr(self.tok, name)

    def encode_batch_fast(self, texts, **how):
        self.calls.append(sum(map(len, texts)))
        return self.tok.encode_batch_fast(texts, **how)


def test_the_tokenizer_gets_a_bounded_number_of_characters_at_once():
    encoder = bpe.PieceEncoder(VOCAB)
    texts = [" ".join(f"w{k}x{i}q, 7{k}\t{i}" for i in range(3_000)) for k in range(40)] + ["", "a  b " * 2_000, " x"]
    want = [[*encoder.tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    encoder.tok = _Counting(encoder.tok)
    ids, off = encoder.encode(texts, 0)
    assert [ids[a:z].tolist() for a, z in zip(off[:-1], off[1:])] == want
    assert sum(encoder.tok.calls) > 2 * bpe._CALL_CHARS >= 2 * max(encoder.tok.calls)


def test_memory_is_given_back_between_batches_and_slabs(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    monkeypatch.setattr(bpe, "release_memory", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["a"])], names=["text"])
    assert len(list(common.released(iter([batch, batch])))) == 2 and len(calls) == 2
    bpe.PieceEncoder(VOCAB).encode(["one two", "three four"], 0, slab=5)
    assert len(calls) == 4


def test_freed_memory_leaves_the_process():
    try:
        with open("/proc/self/statm") as f:
            f.read()
        common._trim().argtypes  # noqa: B018
    except (OSError, AttributeError):
        pytest.skip("needs /proc and glibc")

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    rows = [bytes(600 + i % 300) for i in range(100_000)]
    last = bytes(700)  # above the others in the heap, so malloc alone gives nothing back
    held = resident()
    for _ in common.released(iter([None])):
        rows = None
    assert rows is None and last and held - resident() > 40_000_000
