"""Every registered training-data query over the whole smoke tables: columns, row counts and laws of its contract."""

import hashlib
import zlib
from collections import defaultdict

import brute
import pytest

from vigil.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    found = q.QUERIES[name](spark, SF)
    return [r.asDict(recursive=True) for r in found.collect()]


def by_doc(spark, name, texts):
    got = {r["doc_id"]: r for r in rows(spark, name)}
    assert got.keys() == texts.keys()
    return got


def test_op1(spark, texts):
    for d, r in by_doc(spark, "op1_disclosure", texts).items():
        base = brute.pii(texts[d])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(brute.span_text(base).encode()).hexdigest()
        assert set(filter(None, brute.span_text(base).split(","))) <= set(r["spans"].split(","))


def test_op2(spark, texts):
    got = rows(spark, "op2_spaced_seeds")
    assert got and all(r["doc_id"] in texts and 0 < r["equal_words"] <= r["covered"] <= r["item_words"] and r["first_word"] <= r["last_word"] for r in got)


def test_op3(spark, texts):
    got = by_doc(spark, "op3_virtual_slots", texts)
    for d, r in got.items():
        assert r["size"] == len(texts[d].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[d].encode()) and r["law"] == "key"
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    slots = defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op4(spark, texts):
    got = sorted(by_doc(spark, "op4_dictionary_frames", texts).values(), key=lambda r: r["doc_id"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] >= 1
        at += r["n_tokens"]


def test_op5(spark, texts):
    for d, r in by_doc(spark, "op5_difference_cover", texts).items():
        assert r["n_bytes"] == len(texts[d].encode()) and 0 <= r["n_removed"] <= r["n_bytes"] and (r["n_removed"] > 0) == (r["n_spans"] > 0)


def test_op6(spark, texts):
    for d, r in by_doc(spark, "op6_boosted_rules", texts).items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.quality(texts[d])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_op7(spark, texts):
    assert all(r["doc_id"] in texts for r in rows(spark, "op7_winnowed_licenses"))


def test_op8(spark, texts):
    want = brute.near_components(list(texts.items()), 3, 85)
    for d, r in by_doc(spark, "op8_odd_sketches", texts).items():
        assert (r["n_shingles"], r["component_id"]) == want[d] and r["kept"] == (d == want[d][1])


def test_op9(spark, texts):
    pieces = rows(spark, "op9_large_item_matching")
    assert {r["doc_id"] for r in pieces} == texts.keys()
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_op10(spark):
    html = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in rows(spark, "op10_warc_revisits")}
    assert got.keys() == html.keys()
    largest = {}
    for p, b in html.items():
        largest[b] = max(largest.get(b, p), p)
    for p, r in got.items():
        first = len(html[p]) < 1000 or largest[html[p]] == p
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (
            len(html[p]), hashlib.sha1(html[p]).hexdigest(), "response" if first else "revisit", None if first else largest[html[p]])


def test_op11(spark):
    got = rows(spark, "op11_divergence")
    ranks = defaultdict(list)
    for r in got:
        ranks[r["lang"], r["source"], r["part"]].append((-r["value"], r["item"].encode(), r["rank"]))
    assert all([x[2] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in ranks.values()) and all(len(v) <= 50 for k, v in ranks.items() if k[2] == "term")


def test_op12(spark, texts):
    want = brute.simhash_components(list(texts.items()))
    for d, r in by_doc(spark, "op12_pigeonhole_simhash", texts).items():
        bits = brute.simhash(texts[d])
        assert (r["fingerprint"], r["component_id"]) == (f"{bits:016x}", want[bits])


def test_op13(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: brute.conversation(r) for c, r in brute.damage(table).items()}
    assert {r["conv_id"]: tuple(r.values())[1:] for r in rows(spark, "op13_grammar_repair")} == want
