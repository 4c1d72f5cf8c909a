"""Source divergence, SimHash components and conversation repair against plain versions."""

import itertools
import random

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import conversations, divergence, simhash

SF = "/root/testdata/sf0.001"
CLASHING = ("doc_id long, text string, lang string, source string, term string, n long, docs long, bits long, mask long, key long, least long, "
            "component string, component_id long, kept boolean, members int, sim int, gone int, part string, rank int, value long")
REST = ("t", 1, 2, 3, 4, 5, 6, "c", 7, True, 8, 9, 10, "p", 11, 12)


def wide(spark, rows):
    return spark.createDataFrame([(*r, *REST) for r in rows], CLASHING)


# Divergence


def plain_divergence(rows, min_docs, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), **{c: pa.array([r[k] for r in rows], pa.string()) for k, c in ((1, "text"), (2, "lang"), (3, "source"))}}),
                   tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    return con.execute(divergence.ORACLE.replace(f">= {divergence.MIN_DOCS})", f">= {min_docs})")).fetchall()


def listed(frame):
    return sorted(map(tuple, frame.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence_smoke(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    for least in (30, 8):
        got = listed(divergence.divergence(wide(spark, rows), least))
        assert got and got == sorted(plain_divergence(rows, least, tmp_path))


def test_divergence_awkward(spark, tmp_path):
    rng = random.Random(3)
    words = ["Ab", "aB", "é", "É", "ÅÄ", "x", "y", "zz", "日本", "😀a", "it's", "a1b"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(["en", "", None]), rng.choice(["a", "b", "", None, "é", "B"])) for i in range(120)]
    rows += [(None, None, "solo", "only"), (7, "", "none", "x"), (7, "!!! 12", "none", "y"), (8, "word " * 50_000, "en", "a"), (9, "\x0bq\x0cr\x1cs\x85t", "en", "b")]
    rows += [(500 + i, f"w{chr(97 + i)} same", "tie", "s") for i in range(4)] + [(600, "same", "tie", "t")]
    assert listed(divergence.divergence(wide(spark, rows), 2)) == sorted(plain_divergence(rows, 2, tmp_path))
    assert divergence.divergence(wide(spark, []), 2).count() == 0


def test_divergence_expands_merged_cells_in_order(spark, tmp_path):
    # 80 terms of one cell at the border of the 50 ranks, under a few distinct ones.
    many = " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80))
    rows = [(1, many + " top top top", "en", "a"), (2, many + " rest " * 300, "en", "b"), (3, "top " * 2 + "rest " * 200, "en", "b")]
    got = listed(divergence.divergence(wide(spark, rows), 1))
    assert got == sorted(plain_divergence(rows, 1, tmp_path))
    assert len([r for r in got if r[:3] == ("en", "a", "term")]) == 50


def test_divergence_tiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "_TERMS", 3)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefghijk", k=6)), "en", f"s{i % 7}") for i in range(60)]
    assert listed(divergence.divergence(wide(spark, rows), 2)) == sorted(plain_divergence(rows, 2, tmp_path))


def test_share_is_exact():
    got = duckdb.execute(f"SELECT {divergence._share_sql('9000000000000', '9000000000007', '3')}").fetchone()[0]
    assert got == 1 + 10**9 * 9000000000005 // 9000000000022


# SimHash


def check_simhash(spark, rows):
    got = simhash.near_duplicates(wide(spark, [(d, t, "en", "s") for d, t in rows])).collect()
    want = brute.simhash_components(rows)
    signed = {b - (1 << 64) if b >> 63 else b: c for b, c in want.items()}
    assert sorted(map(repr, ((r.doc_id, r.bits, r.component_id) for r in got))) == sorted(
        map(repr, ((d, b - (1 << 64) if (b := brute.simhash(t)) >> 63 else b, signed[b - (1 << 64) if b >> 63 else b]) for d, t in rows)))
    return got


def test_simhash(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert len({r.component_id for r in check_simhash(spark, rows)}) < len(rows)
    base = [f"w{i}" for i in range(400)]
    near = [(1000 + i, " ".join(base[:i] + ["Other"] + base[i + 1:])) for i in range(0, 60, 3)]
    odd = [(1, None), (2, ""), (None, " \t"), (4, "One two"), (4, "one  TWO"), (5, "x"), (6, "é É x y z"), (7, "a\x1cb c d e"), (None, "alone here now yes"), (8, "w " * 200_000)]
    check_simhash(spark, near + odd + odd[:3])
    assert simhash.near_duplicates(wide(spark, [])).count() == 0
    kept = simhash.drop_near_duplicates(wide(spark, [(d, t, "en", "s") for d, t in near + odd]))
    assert kept.columns == wide(spark, []).columns
    assert {r.doc_id for r in kept.collect()} >= {1000, None} and kept.filter("doc_id = 2").count() == 0


def test_simhash_full_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 300)
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(4)]
    bits = {c ^ sum(1 << k for k in rng.sample(range(64), n)) for c in centres for n in (0, 1, 3, 5, 7) for _ in range(60)}
    bits |= {x & ~0x1FFF for x in bits}  # one block the same for a third of all
    frame = spark.createDataFrame([(b - (1 << 64) if b >> 63 else b,) for b in bits], "bits long")
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)

    def classes(pairs):
        up = {b: b for b in bits}

        def top(b):
            while up[b] != b:
                up[b] = up[up[b]]
                b = up[b]
            return b

        for a, b in pairs:
            up[top(a)] = top(b)
        groups = {}
        for b in bits:
            groups.setdefault(top(b), set()).add(b)
        return sorted(map(sorted, groups.values()))

    ordered = np.array(sorted(bits), np.uint64)
    every = [(int(a), int(b)) for i, a in enumerate(ordered) for b in ordered[i + 1:][np.bitwise_count(ordered[i + 1:] ^ a) <= 4]]
    assert len(every) > len(bits) and classes(got) == classes(every)


def test_forest_is_small():
    bits = np.array([1 << k for k in range(64)], np.uint64)  # all two apart
    assert len(simhash._forest(bits, 4)) == 63 and simhash._forest(bits, 1) == []


# Conversations


def check_conversations(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "conv_id long, turn long, role string, text string, copies int, head string, part int, gaps long")
    got = conversations.audits(conversations.damaged(frame), frame)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    want = {c: brute.conversation(r) for c, r in brute.damage(rows).items()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], (c, brute.damage(rows)[c])
    return frame


def test_conversations_smoke(spark):
    check_conversations(spark, [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_conversations_awkward(spark):
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "s", "User", "ua"], ["", " \t", None, "Yes.", "yes! \n", "no", "end?", "…", "a.b", "x\x1c", "Long. " * 3000]
    rows = []
    for c in [*range(220), None]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([t, t, t, 2 * t, 0, None, -3]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts) if rng.random() < 0.6 else f"text {t}{rng.choice('.!? ')}"))
    rows += rows[:40]  # repeated rows
    frame = check_conversations(spark, rows)
    repaired = conversations.repair(conversations.damaged(frame)).collect()
    import hashlib

    by_conv = {}
    for r in sorted(repaired, key=lambda r: r.place):
        by_conv.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, damaged in brute.damage(rows).items():
        assert hashlib.sha256("\n".join(by_conv.get(c, [])).encode()).hexdigest() == brute.conversation(damaged)[-1]
    assert conversations.audits(conversations.damaged(frame.limit(0)), frame.limit(0)).count() == 0


def test_one_conversation_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 7)
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["Same.", f"own {t}.", f"cut {t}", ""])) for t in range(600)]
    rows += [(2, 3, "user", "copy.")] * 50 + [(3, None, "assistant", f"n{t}.") for t in range(30)]
    frame = check_conversations(spark, rows)
    chunked = conversations.chunks(conversations.damaged(frame))
    assert chunked.filter("conv = '1'").select("part").distinct().count() > 1  # one conversation, several tasks
    assert all(len(r.symbols) <= 7 for r in chunked.collect())


def test_grammar_is_shared_and_exact():
    rng = random.Random(8)
    seq = ["".join(chr(65 + rng.choice([0, 3, 4, 7, 8, 11, 12, 1, 6])) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    plain, some = conversations.Grammar([]), conversations.Grammar(["EI", "Ā" + "Ā", "AE", "ā" + "E", "Ā" + "H"])
    assert any(len(some.compressed(s)) < len(s) for s in seq)
    for s in seq + ["EI" * 50]:
        (c1, r1, s1, _), (c2, r2, s2, _) = plain.folded(s), some.folded(some.compressed(s))
        assert (c1 == c2).all() and s1 == s2
        for p, q in itertools.product(range(4), range(4)):
            if c1[p, q] < conversations._NEVER:
                assert plain.audit(s, p, q) == some.audit(s, p, q)
                assert r1[p, q] == r2[p, q]
                # The rank is the order of the strings themselves.
                strings = sorted(plain.audit(s, p, x) for x in range(4) if c1[p, x] < conversations._NEVER)
                assert strings.index(plain.audit(s, p, q)) == r1[p, q]


# Clashing names and stretches of the earlier filters


def test_filters_pass_any_columns_through(spark):
    from vigil.llm import decontaminate, neardup, pii

    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen mail a.b@c.de"
    schema = "doc_id long, text string, pii_key long, pii_doc long, pii_spans string, pii_hash long, pii_marks int, near_id long, bad_id long, bad_hash long, sim_id long"
    docs = spark.createDataFrame([(i, t, *range(9)) for i, t in ((1, text), (2, text), (3, "other words entirely here"), (None, None))], schema)
    bench = spark.createDataFrame([(1, "other words entirely here")], "item_id long, text string")
    assert {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[1].endswith("mail [EMAIL]")
    assert {r.doc_id for r in neardup.drop_near_duplicates(docs).collect()} == {1, 3, None}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {1, 2, None}
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} >= {1, 3}
    for out in (pii.sanitise(docs), neardup.drop_near_duplicates(docs), decontaminate.drop_contaminated(docs, bench), simhash.drop_near_duplicates(docs)):
        assert out.schema == docs.schema and {tuple(r)[2:] for r in out.collect()} == {tuple(docs.first())[2:]}


def test_passages_in_several_stretches(spark):
    from vigil.llm import decontaminate

    words = [f"w{i}" for i in range(40)]
    x = [f"x{i}" for i in range(80)]
    docs = {
        1: x[:9] + words[:10] + x[9:30] + words[30:40] + x[30:40],  # two halves, 20 of 40
        2: sum((words[i:i + 7] + [x[i]] for i in range(0, 21, 7)), []),  # an insertion after every 7
        3: x[:9] + words[:9] + x[9:30],  # 9 of 40
        4: words[:7] + x[:3] + words[7:12] + x[3:9],  # 12 of 40
    }
    items = {1: words, 2: words[:21]}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.equal) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got[1, 1] == (20, 20) and got[2, 2] == (21, 21) and got[2, 1] == (21, 21)
    assert (3, 1) not in got and (4, 1) not in got
