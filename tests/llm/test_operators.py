"""The training-data operators against plain versions, on the smoke tables and on awkward rows."""

import hashlib
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import binary_ids, bpe, decontaminate, grams, licenses, minhash, neardup, packing, pii, quality, sharding, suffix, warc

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
P1 = "the quick brown fox jumps over the lazy dog while seven wizards brew quite odd potions near a frozen lake at dawn and sing"
P2 = "many small boats drift past the old harbour wall where grey gulls argue loudly about bread and nobody ever listens to them at all"
ODD = [
    (1, P1), (2, P1), (3, P1 + " today"), (4, None), (5, ""), (6, " \t\n "), (7, "x"), (8, P2 + " " + P1), (9, "aaaa" * 400), (10, "ab" * 900),
    (11, "é ü ñ " * 200 + P2), (12, "call +1 (555) 123-4567 or a.b@c.de.f or 10.0.0.1, 256.1.1.1 card 4111 1111 1111 1111 end"),
    (13, "Released under the MIT License.\n" * 3), (14, "#" * 300), (15, "one two three four five " * 30), (16, "word " * 9), (None, P2), (None, None),
    (17, "<|endoftext|> a  b \n c  d\x1c e "), (18, P1), (18, P1), (20, "z" * 49), (21, "z" * 50), (22, "z" * 50)]
CLASHING = "doc_id long, text string, lang string, n_words long, kept boolean, term string, row long, chunk long, bucket int, id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "en", 1, None, "x", 2, 3, 4, 5) for d, t in ODD], CLASHING)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASHING)


def both(docs, odd, plain):
    return [(docs, plain), (odd, ODD)]


def key(row):
    return repr(tuple(row))


def test_pii_base_spans(docs, odd, none, plain):
    for frame, rows in both(docs, odd, plain):
        got = pii.find_spans(frame, pii.disclosing_terms(frame).select("term"))
        got = got.select("doc_id", pii.spans_text("base").alias("base"), F.sha2(pii.spans_text("base"), 256).alias("sha")).collect()
        want = [(d, brute.span_text(brute.pii(t))) for d, t in rows]
        assert sorted(map(key, ((r.doc_id, r.base) for r in got))) == sorted(map(key, want))
        assert all(r.sha == hashlib.sha256(r.base.encode()).hexdigest() for r in got)
    assert pii.find_spans(none, pii.disclosing_terms(none).select("term")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@-1 +2()5%é\n", max_size=40))
def test_pii_patterns(text):
    assert pii.base_spans(text) == brute.pii(text)


def test_pii_terms_that_disclose(spark):
    rows = [(i, f"filler {'abcdef'[i] * 4} goes here our contact Zebulon writes from zeb@mail.example.com and {'uvwxyz'[i] * 5}") for i in range(6)]
    rows += [(100 + i, f"plain text about nothing here our contact is away today {i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.term: r.disclosure for r in pii.disclosing_terms(frame).collect()}
    assert terms["zebulon"] == pytest.approx(1) and "contact" not in terms and "here" not in terms
    out = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert "Zebulon" not in out[0] and "[EMAIL]" in out[0] and out[100] == rows[6][1] and len(out) == len(rows)
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(9)] + rows[6:], "doc_id long, text string")
    assert pii.disclosing_terms(copies).count() == 0  # copies are one context


def test_pii_sanitise_keeps_rows_and_columns(odd, none):
    out = pii.sanitise(odd)
    assert out.schema == odd.schema and out.count() == len(ODD)
    assert "4111" not in "".join(r.text or "" for r in out.collect())
    assert pii.sanitise(none).count() == 0


def test_decontaminate(spark, odd, none):
    long = " ".join(f"w{i}" for i in range(60))
    changed = " ".join(f"w{i}" if i % 6 else f"v{i}" for i in range(60))
    items = spark.createDataFrame([(1, P1), (2, long), (3, "tiny item words"), (4, None), (5, ""), (None, P2), (6, long)], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"before {P1} after"), (2, f"a b c {changed} d"), (3, "say tiny item words now"), (4, "tiny item word"), (5, P1[:40]),
                                  (6, None), (7, long[:70]), (8, " ".join(f"w{i}" for i in range(32)) + " the end"), (9, P1.upper().replace(" ", ", ")),
                                  (None, P2), (11, "x " * 3000 + long), (12, "begin " + " ".join(f"w{i}" for i in range(20, 33)) + " end"),
                                  (13, "begin " + " ".join(f"w{i}" for i in range(20, 32)) + " end")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.item_words, r.covered, r.equal) for r in decontaminate.contaminated(rows, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (2, 6), (3, 3), (8, 2), (8, 6), (9, 1), (None, None), (11, 2), (11, 6), (12, 2), (12, 6), (7, 2), (7, 6)}
    assert got[1, 1] == (24, 24, 24) and got[8, 2] == (60, 32, 32) and got[2, 2][2] == 50
    kept = decontaminate.drop_contaminated(rows, items)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 13]
    assert decontaminate.drop_contaminated(odd, items).schema == odd.schema
    empty = items.limit(0)
    assert decontaminate.drop_contaminated(odd, empty).count() == len(ODD)
    assert decontaminate.contaminated(none, items).count() == 0


def test_decontaminate_smoke_tables(spark, docs, plain):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    words = {r.item_id: brute.normal_words(r.text) for r in items.collect()}
    want = {(d, i) for d, t in plain for i, w in words.items() if 100 * brute.best_shift(brute.normal_words(t), w) >= 90 * len(w)}
    near = {(d, i) for d, t in plain for i, w in words.items() if 100 * brute.best_shift(brute.normal_words(t), w) >= 40 * len(w)}
    assert want <= got <= near and want


def test_sharding(docs, odd, none, plain, spark):
    base = sharding.base_map(spark, 24)
    grown = {r.vslot: r.shard for r in sharding.grow_map(base).collect()}
    old = {r.vslot: r.shard for r in base.collect()}
    assert len(grown) == sharding.SLOTS and all(grown[v] in (old[v], 24) for v in old)
    assert max(np.bincount(list(grown.values()))) - min(np.bincount(list(grown.values()))) <= 1
    for frame, rows in both(docs, odd, plain):
        got = sharding.assign(sharding.with_slots(frame), base).collect()
        want = sorted(key((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for d, t in rows)
        assert sorted(key((r.doc_id, r.size, r.text_crc32)) for r in got) == want
        places = defaultdict(list)
        for r in got:
            places[r.shard].append(r.slot)
            assert r.shard == old[r.vslot]
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.assign(sharding.with_slots(none), base).count() == 0


def test_sharding_rebalance(spark):
    base = sharding.base_map(spark, 4, 64)
    sizes = spark.createDataFrame([(v, 1, 1000 if v % 4 == 0 else 10 + v) for v in range(64)], "vslot int, rows long, bytes long")
    after = sharding.rebalance_map(base, sizes)
    moved = after.join(sizes, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert after.count() == 64 and {r.version for r in after.collect()} == {2}
    assert max(r.b for r in moved) < 6000  # 16,000 before
    same = sharding.rebalance_map(base, spark.createDataFrame([(v, 1, 5) for v in range(64)], "vslot int, rows long, bytes long"))
    assert same.drop("version").exceptAll(base.drop("version")).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab 1'.\n\t  é　")), max_size=30), min_size=1, max_size=5))
def test_bpe_pieces_are_exact(texts):
    encoder = bpe.encoder(VOCAB)
    ids, off = encoder.encode(texts, 7)
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == [*encoder.tok.encode(t, add_special_tokens=False).ids, 7]


def test_bpe_forgets(plain):
    small, texts = bpe.PieceEncoder(VOCAB, cache=50), [t for _, t in plain[:30]]
    for t in texts:
        ids, off = small.encode([t, "", t], 0)
        want = [*small.tok.encode(t, add_special_tokens=False).ids, 0]
        assert ids.tolist() == [*want, 0, *want] and off.tolist() == [0, len(want), len(want) + 1, 2 * len(want) + 1]


def plain_ids(rows, end):
    tok = Tokenizer.from_file(VOCAB)
    return [(d, [*tok.encode(t or "", add_special_tokens=False).ids, end]) for d, t in rows]


@pytest.mark.parametrize("dictionary", [True, False])
def test_binary_ids_round_trip(spark, docs, odd, plain, tmp_path, dictionary):
    for k, (frame, rows) in enumerate(both(docs, odd, plain)):
        folder = str(tmp_path / f"ids{k}")
        (tmp_path / f"ids{k}").mkdir()
        words = binary_ids.train_dictionary(frame, VOCAB, 2) if dictionary else b""
        (tmp_path / f"ids{k}" / "dictionary.zdict").write_bytes(words)
        manifest = binary_ids.write_shards(frame, folder, words, VOCAB, 2, 3)
        got = binary_ids.with_global_start(binary_ids.read_shards(manifest, folder), manifest).orderBy("start").collect()
        ids = plain_ids(rows, 2)
        assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
        assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
        assert sorted(key((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(key((d, len(i), brute.ids_crc(i))) for d, i in ids)
        file = {r.shard: r.file for r in manifest.collect()}
        for r in got[:5]:
            assert brute.ids_crc(binary_ids.read_document(folder, file[r.shard], r.row)) == r.ids_crc32


def test_binary_ids_empty(none, tmp_path):
    (tmp_path / "dictionary.zdict").write_bytes(binary_ids.train_dictionary(none, VOCAB, 2))
    manifest = binary_ids.write_shards(none, str(tmp_path), b"", VOCAB, 2, 3)
    assert binary_ids.with_global_start(binary_ids.read_shards(manifest, str(tmp_path)), manifest).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_order(numbers):
    s = np.array(numbers, np.int64)
    assert grams.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: numbers[i:])


def test_substrings(docs, odd, none, plain):
    for frame, rows in both(docs, odd, plain):
        got = suffix.report(suffix.dedup_substrings(frame)[0]).collect()
        assert len(got) == len(rows)
        want = brute.substrings([(d, t) for d, t in rows if d is not None])
        for r in got:
            if r.doc_id is None:
                assert (r.n_removed, r.n_spans) == (0, 0)
            else:
                assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert suffix.report(suffix.dedup_substrings(none)[0]).count() == 0


def test_substrings_remaining(odd):
    kept = {r.doc_id: bytes(r.kept) for r in suffix.remaining(suffix.dedup_substrings(odd)[0]).collect()}
    assert kept[2] == b"" and kept[1] == P1.encode() and kept[20] == b"z" * 49 and kept[22] == b""


def test_quality_statistics(plain):
    rows = plain + ODD
    stats, x = quality.statistics([t or "" for _, t in rows])
    assert [tuple(int(stats[c][i]) for c in quality.BASE) for i in range(len(rows))] == [brute.quality(t) for _, t in rows]
    assert np.isfinite(x).all()
    assert quality.statistics([])[1].shape == (0, len(quality.FEATURES))


def test_quality_trees(spark, docs, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x, y = quality.labelled_features(many, labels)
    even = np.arange(len(y)) % 2 == 0
    model = quality.fit(x[even], y[even])
    right = (model.score(x[~even]) >= 0) == (y[~even] > 0)
    assert right.mean() > 0.9  # held out
    j = quality.FEATURES.index("symbols")
    rising = np.repeat(x[:50], 20, 0)
    rising[:, j] = np.tile(np.linspace(0, 3, 20), 50)
    assert (np.diff(model.score(rising).reshape(50, 20), axis=1) <= 1e-9).all()
    scored = quality.score_documents(odd, model).collect()
    assert len(scored) == len(ODD) and not any(r.kept for r in scored if r.n_words < 10)
    kept = quality.filter_documents(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score_documents(docs, model).collect() if r.kept}
    assert quality.score_documents(none, model).count() == 0
    assert quality.fit(x, np.ones(len(y))) is None and quality.fit_quality(docs, labels.limit(0)) is None
    assert {r.kept for r in quality.score_documents(docs, None).collect() if not r.base_failed} == {True}


def test_licenses(spark, odd, none):
    apache = licenses.TEMPLATES[3][1]
    rows = spark.createDataFrame([(1, f"Some text. {apache} More text."), (2, "Released under the MIT License."), (3, "licensed to nobody"), (4, None),
                                  (5, "x " * 4000 + apache.replace("compliance", "full compliance").replace("obtain", "get")),
                                  (6, "Licensed under CC BY 4.0. And: Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = defaultdict(list)
    for r in licenses.scan_licenses(rows).orderBy("start").collect():
        got[r.doc_id].append(r)
    assert set(got) == {1, 2, 5, 6}
    assert [(r.license, r.coverage_percent, r.start) for r in got[1]] == [("Apache-2.0", 100, 11)] and got[1][0].end == 11 + len(apache)
    assert [(r.license, r.start, r.end) for r in got[2]] == [("MIT", 0, 31)]
    assert got[5][0].coverage_percent >= 90 and got[5][0].start == 8000
    assert [r.license for r in got[6]] == ["CC-BY-4.0", "CC-BY-NC-4.0"]
    assert [r.doc_id for r in licenses.scan_licenses(odd).collect()] == [13, 13, 13]
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_smoke_tables(docs, plain):
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = sorted((d, lines[x], t.index(x), t.index(x) + len(x)) for d, t in plain for x in lines if x in t)
    assert sorted((r.doc_id, r.license, r.start, r.end) for r in licenses.scan_licenses(docs).collect()) == want and want


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, odd, none, plain, words, percent):
    for frame, rows in both(docs, odd, plain):
        got = neardup.near_duplicates(frame, words, percent).collect()
        want = brute.near_components([(d, t) for d, t in dict(rows).items() if d is not None], words, percent)
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert neardup.near_duplicates(none, words, percent).count() == 0


def test_near_duplicates_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):  # links between these are neither all nor none
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 5)):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((d, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, 3, 85).collect()}
    assert got == {d: c for d, (_, c) in brute.near_components(rows, 3, 85).items()}
    kept = neardup.drop_near_duplicates(frame, 3, 85)
    assert {r.doc_id for r in kept.collect()} == set(got.values()) and kept.schema == frame.schema


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101)] + [(200, 200 + i) for i in range(1, 30)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.id: r.component for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{200 + i: 200 for i in range(30)}}
    assert neardup.components(links.limit(0)).count() == 0


def test_odd_sketches():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    for shared in (400, 380, 300, 100, 0):
        b = np.unique(np.concatenate([a[:shared], rng.integers(0, 1 << 62, len(a) - shared).astype(np.uint64)]))
        differ = len(a) + len(b) - 2 * shared
        whole = int(np.bitwise_count((minhash.set_sketch(a) ^ minhash.set_sketch(b)).view(np.uint64)).sum())
        odd = int(np.bitwise_count((minhash.odd_sketch(minhash.signature(a)) ^ minhash.odd_sketch(minhash.signature(b))).view(np.uint64)).sum())
        assert whole <= differ
        similarity = shared / (len(a) + len(b) - shared)
        assert (odd <= minhash.most_flips(0.8)) == (similarity > 0.6)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
def test_packing_plan(counts):
    intervals, bins = packing.plan(counts, 64)
    held = defaultdict(list)
    for s, c in counts.items():
        for rank in range(c):
            (row,) = [r for r in intervals if r[0] == s and r[1] <= rank < r[2]]
            k = rank - row[1]
            held[row[3] + k // row[4]].append((row[5] + k % row[4] * s, s))
    assert len(held) == bins
    for items in held.values():
        at = 0
        for offset, s in sorted(items):
            assert offset == at
            at += s
        assert at <= 64
    total, large = sum(s * c for s, c in counts.items()), sum(c for s, c in counts.items() if s > 32)
    assert max(-(-total // 64), large) <= bins <= 1.5 * max(-(-total // 64), large) + 1


def test_packing(docs, odd, none, plain):
    for frame, rows in both(docs, odd, plain):
        got = packing.pack_documents(frame, VOCAB).collect()
        by, sequences = defaultdict(list), defaultdict(list)
        for r in got:
            by[r.doc_id].append((r.start, r.length, r.ids_crc32))
            sequences[r.sequence_id].append((r.offset, r.length))
        want = defaultdict(list)
        for d, ids in plain_ids(rows, 0):
            first = len(ids) % 2048 or min(len(ids), 2048)
            for a, z in [(0, first)] + [(a, a + 2048) for a in range(first, len(ids), 2048)]:
                want[d].append((a, z - a, brute.ids_crc(ids[a:z])))
        assert {d: sorted(v) for d, v in by.items()} == {d: sorted(v) for d, v in want.items()}
        for items in sequences.values():
            assert sorted(o for o, _ in items) == np.cumsum([0] + [n for _, n in sorted(items)])[:-1].tolist() and sum(n for _, n in items) <= 2048
    assert packing.pack_documents(none, VOCAB).count() == 0


def read_back(pages, tmp_path):
    manifest = warc.write_archives(warc.with_record_types(pages), str(tmp_path))
    return warc.resolve_revisits(warc.read_archives(manifest, str(tmp_path)))


def test_warc(spark, tmp_path):
    big, other = "<html>" + "é" * 700 + "\r\n\r\nWARC/1.1\r\n</html>", "y" * 1000
    rows = [(1, "u1", big), (2, "u2", big), (3, "u 3\n", big), (4, None, other), (5, "", "y" * 999), (6, "u", "y" * 999), (7, "u", None), (8, "u", ""), (9, "u", other),
            (None, "u", big), (11, "a", "z" * 2000), (11, "b", "z" * 2000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, record_type string, digest int")
    got = read_back(pages, tmp_path).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max((j for j, _, g in rows if j is not None and (g or "").encode() == b), default=None)
        revisit = i is not None and len(b) >= 1000 and i < top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(map(key, want))
    assert read_back(pages.limit(0), tmp_path).count() == 0


def test_warc_pages(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in read_back(pages, tmp_path).collect()}
    assert got == {r.page_id: (len(r.html.encode()), hashlib.sha1(r.html.encode()).hexdigest()) for r in pages.collect()}


def _siblings(rng, n, words, edits):
    """Texts from one template, each with words of its own at ``edits`` places."""
    out = []
    for d in range(n):
        text = [f"w{i}" for i in range(words)]
        for at in rng.choice(words, edits, replace=False):
            text[at] = f"x{d}.{at}"
        out.append(" ".join(text))
    return out


def _open_frame(spark, texts, words):
    sets = minhash.shingle_sets(texts, words)
    rows = [(d, d, len(s), minhash.odd_sketch(minhash.signature(s)).tolist(), minhash.set_sketch(s).tolist(), s.tobytes()) for d, s in enumerate(sets)]
    return neardup.widened(spark.createDataFrame(rows, "key long, id long, n long, odd array<long>, whole array<long>, members binary")), sets


def _similar(sets, percent):
    common = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    return {(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)}


def test_siblings_below_the_threshold_are_no_pairs(spark):
    """Long texts at 0.74 of each other: the short sketches let them pass, the wide ones do not."""
    frame, sets = _open_frame(spark, _siblings(np.random.default_rng(3), 40, 5000, 80), 5)
    share = len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1]))
    assert 0.7 < share < 0.78
    labels = spark.createDataFrame([], "id long, component long")
    groups = neardup.rare_groups(frame, 80)
    assert groups.count() > 0
    for nearest in (True, False):
        pairs = neardup._across(groups, frame, labels, 80, nearest)
        assert neardup.screen(pairs, frame, 80).count() <= len(sets)


@pytest.mark.parametrize("block", [7, 1024])
def test_groups_lose_no_pair(spark, block):
    """Pairs above and below the threshold, in groups of one unit and of many pairs of blocks, with a component over a block."""
    rng = np.random.default_rng(11)
    texts = _siblings(rng, 36, 150, 2) + _siblings(rng, 12, 150, 3) + ["w1 w2 w3", "w1 w2 w3 w4", "w7", "w8"]
    frame, sets = _open_frame(spark, texts, 3)
    want = _similar(sets, 85)
    labels = spark.createDataFrame([(d, 0) for d in range(16)] + [(d, 40) for d in (40, 41, 42)], "id long, component long")
    comp = {d: 0 if d < 16 else 40 if d in (40, 41, 42) else d for d in range(len(sets))}
    want = {(a, b) for a, b in want if comp[a] != comp[b]}
    groups = neardup.rare_groups(frame, 85)
    got = {(r.a, r.b) for r in neardup._across(groups, frame, labels, 85, False, block).collect()}
    assert got >= want and len(want) > 50 and all(comp[a] != comp[b] for a, b in got)
    pairs = spark.createDataFrame(sorted(got), "a long, b long")
    assert got >= {(r.a, r.b) for r in neardup.screen(pairs, frame, 85).collect()} >= want
    near = {(r.a, r.b) for r in neardup._across(groups, frame, labels, 85, True, block).collect()}
    assert near <= got and {x for p in near for x in p} == {x for p in got for x in p}
    sizes = neardup._units(groups.join(labels, "id", "left").selectExpr("*", "coalesce(component, id) as c").drop("component").withColumnRenamed("c", "component"), block)
    assert sizes.groupBy("unit").count().agg({"count": "max"}).first()[0] <= 6 * block


def test_near_duplicates_in_small_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(d, t) for d, t in enumerate(_siblings(rng, 30, 150, 2) + _siblings(rng, 30, 150, 3))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, block=8).collect()}
    assert got == {d: c for d, (_, c) in brute.near_components(rows, 3, 85).items()}
