"""The pipeline against a plain version, and the registration of its queries."""

import brute
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from __spark_entry__ import oracle_sql, queries
from vigil.llm import quality
from vigil.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_registered():
    q = queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES} and set(QUERIES) | {"pipeline"} <= set(q)
    assert set(oracle_sql()) <= set(q)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "personal_data", "best_fit_packing"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert docs.schema.simpleString() == spark.read.parquet(f"{SF}/documents.parquet").schema.simpleString()
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        frames.append(docs)
    rules, near, clean, private, packed = [[r.asDict() for r in f.collect()] for f in frames]
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    stats, x = quality.statistics([r.text or "" for r in source])
    good = quality.judge(stats, x, model)[2]
    assert {r["doc_id"] for r in rules} == {r.doc_id for r, g in zip(source, good) if g}
    groups = brute.near_components([(r["doc_id"], r["text"]) for r in rules], 5, 80)
    assert {r["doc_id"] for r in near} == {d for d, (_, c) in groups.items() if c == d}
    items = [brute.normal_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in near if any(10 * brute.best_shift(brute.normal_words(r["text"]), w) >= 9 * len(w) for w in items)}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in near} - leaks
    before = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"] for r in private} == set(before)
    for r in private:
        spans = brute.pii(before[r["doc_id"]])
        assert not brute.pii(r["text"]) and (spans or r["text"] == before[r["doc_id"]])
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in private}
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == sizes
