"""Texts that hold the content of an added token have the ids of the library with its defaults."""

from collections import defaultdict

import brute
import public_tokenizers
from tokenizers import Tokenizer

from vigil.llm import bpe, packing

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [f"a {END} b", END, f"{END}{END}", f" {END} ", f"x{END}y z, w. x{END}y", f"tab\t{END}\tand  {END}\n two", "<|endoftext", "|> a", "a b z, w.", "", "  ",
         f"many words before, {END}", "many words before, <|endof text|>"]


def library_ids(text):
    return Tokenizer.from_file(VOCAB).encode(text, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_library():
    assert library_ids(TEXTS[0]) == [64, 220, 50256, 275]
    small, want = bpe.PieceEncoder(VOCAB, cache=5), [[*library_ids(t), 7] for t in TEXTS]
    for texts, ids_of in [(TEXTS, want), (TEXTS[::-1], want[::-1]), *(([t], [w]) for t, w in zip(TEXTS, want))]:
        ids, off = small.encode(texts, 7)
        assert [ids[a:z].tolist() for a, z in zip(off, off[1:])] == ids_of


def test_packing_counts_added_tokens(spark):
    rows = [*enumerate(TEXTS), (100, f"word {END} " * 1500)]
    got = defaultdict(list)
    for r in packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), VOCAB).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    want = {}
    for d, t in rows:
        ids = [*library_ids(t), 0]
        want[d] = [(a, n, brute.ids_crc(ids[a:a + n])) for a, n in packing.cut(len(ids), packing.CAPACITY)]
    assert {d: sorted(p) for d, p in got.items()} == {d: sorted(p) for d, p in want.items()}
