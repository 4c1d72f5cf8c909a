"""A short passage in many surroundings: its different strings are dealt out, and the result stays whole."""

from collections import Counter

import brute
import numpy as np
import pytest

from vigil.llm import suffix

HEAD = "Filed under the heading: "  # shorter than 50 bytes


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for d in range(300):
        own = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 60))
        out.append((d, f"{own} {HEAD}{own[::-1]}{'z' * (d % 90)}"))
    return [*out, (300, out[7][1]), (301, f"say {out[9][1][20:]}"), (302, "z" * 3000), (302, HEAD), (303, "")]


def test_no_hash_is_kept_whole(spark, rows):
    chunks = suffix.chunk_table(spark.createDataFrame(rows, "doc_id long, text string"))
    for hot_bytes in (suffix.HOT_BYTES, 1):
        masks, hot = suffix.repeated_hashes(chunks, 8, hot_bytes)
        strings = suffix.repeatable_strings(chunks.join(masks, "chunk", "left"), 8, hot).collect()
        held, different = Counter(), set()
        for r in strings:
            head, _, key, sid = suffix._unpack(bytes(r.strings), hot)
            different |= set(zip(key.tolist(), sid.tolist(), head["size"].tolist()))
        for key, _, size in different:
            held[key] += size
        assert (max(held.values()) < 4000) == (len(hot) > 0) == (hot_bytes == 1)


@pytest.mark.parametrize("hot_bytes", [1, suffix.HOT_BYTES])
def test_results_are_those_of_the_plain_version(spark, rows, hot_bytes):
    rows = [r for r in rows if r != (302, HEAD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(suffix.dedup_substrings(frame, hot_bytes)[0]).collect()}
    assert got == brute.substrings(rows)
