"""Personal data: base patterns, and terms that disclose protected entities by corpus co-occurrence.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Their values
are the protected entities. A term (a word of three letters or more) reveals entity e by

    disclosure(e; t) = PMI(e; t) / IC(e) = log2(p(e|t) / p(e)) / -log2 p(e),

which is 1 when the term occurs only with the entity. Counts are numbers of documents: the
entity and the term co-occur where the term stands within ``REACH`` words of the entity. Terms
seen in at least ``CONTEXTS`` different contexts of the entity (copies of one passage are
one context), each further one of which brings ``FRESH`` new words on average (those of near
copies bring fewer), and with a disclosure of at least ``THRESHOLD`` are marked wherever they occur.
Those with disclosure 1 are removed from the text, the others generalised to ``[TERM]``; base
spans become ``[EMAIL]`` and so on.

Scale: only documents with entities emit contexts; document frequencies are counted for
terms with enough contexts; the disclosing terms reach the scan of the texts as a bitmap of
fixed size and are confirmed by a join. Nothing that grows with the corpus is broadcast.

Nulls: a null text is empty; a null id is kept. Repeated rows are judged one by one and
count as documents; their contexts count once. Empty tables give no rows. ``sanitise``
passes other columns through, whatever their names; the others ignore them. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import bitmap, materialise, out_batch, released, small_batches, table, text_or_empty, unused

KINDS = ["email", "ip", "card", "phone", "term"]
REACH, CONTEXTS, FRESH, THRESHOLD = 8, 3, 2.0, 0.9
#: Bits of the bitmap of terms; its size does not depend on the data.
FILTER_BITS = 1 << 23
# The base patterns of the contract, written so that no start is tried twice.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` by start, then kind; leftmost and non-overlapping in each kind."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, 0, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(text: str, span: tuple[int, int, int]) -> str:
    value = text[span[0]:span[2]].lower()
    return f"{KINDS[span[1]]}:{''.join(_DIGIT.findall(value)) if span[1] > 1 else value}"


def _contexts(text: str, spans: list[tuple[int, int, int]]):
    """``(entity, term, context)``: the terms within ``REACH`` words of each entity, outside all spans."""
    words = [(m.start(), m.group().lower()) for m in _TERM.finditer(text)]
    starts = np.array([w[0] for w in words])
    inside = np.zeros(len(words), bool)
    for a, _, b in spans:
        inside |= (starts >= a) & (starts < b)
    words = [w for w, i in zip(words, inside) if not i]
    starts = starts[~inside]
    for s in spans:
        at = int(np.searchsorted(starts, s[0]))
        near = [w for _, w in words[max(0, at - REACH):at + REACH]]
        entity, context = _entity(text, s), " ".join(near)
        for w in set(near):
            yield entity, w, context


def entity_contexts(docs: DataFrame) -> DataFrame:
    """``(entity, term, contexts, docs, fresh)`` of pairs with several contexts: different contexts, and documents,
    in which they stand together, and the words that each further context brings, on average (stored)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("entity", pa.string()), ("term", pa.string()), ("context", pa.string()), ("n", pa.int64())])

    def run(batches):
        for b in released(batches):
            seen: Counter = Counter()
            for t in b.column("text").to_pylist():
                if spans := base_spans(t):
                    # A term counts once a document, in the first context of the entity there.
                    first = {}
                    for e, w, c in _contexts(t, spans):
                        first.setdefault((e, w), c)
                        seen[e, w, c] += 0
                    for (e, w), c in first.items():
                        seen[e, w, c] += 1
            yield out_batch(schema, [*([k[i] for k in seen] for i in range(3)), list(seen.values())])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(run, "entity string, term string, context string, n long")
    once = materialise(rows.groupBy("entity", "term", "context").agg(F.sum("n").alias("n")), "pii-contexts")
    size = F.size(F.split("context", " "))
    pairs = once.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("docs"), F.max(size).alias("size"))
    pairs = pairs.filter(F.col("contexts") >= 2)
    words = once.join(pairs.select("entity", "term"), ["entity", "term"]).select("entity", "term", F.explode(F.split("context", " ")).alias("word"))
    words = words.distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("words"))
    fresh = (F.col("words") - F.col("size")) / (F.col("contexts") - 1)
    return materialise(pairs.join(words, ["entity", "term"]).select("entity", "term", "contexts", "docs", fresh.alias("fresh")), "pii-pairs")


def entity_documents(docs: DataFrame) -> DataFrame:
    """``(entity, docs)``: documents that hold an entity."""
    schema = pa.schema([("entity", pa.string()), ("n", pa.int64())])

    def run(batches):
        for b in released(batches):
            seen: Counter = Counter()
            for t in b.column("text").to_pylist():
                seen.update({_entity(t, s) for s in base_spans(t)})
            yield out_batch(schema, [list(seen), list(seen.values())])

    return (docs.select(text_or_empty().alias("text")).mapInArrow(run, "entity string, n long")
            .groupBy("entity").agg(F.sum("n").alias("entity_docs")))


def term_bitmap(terms: DataFrame) -> np.ndarray:
    """Two bits a term in a bitmap of ``FILTER_BITS`` bits."""
    h = F.xxhash64("term")
    return bitmap(terms.select(F.explode(F.array(F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftright(h, 32), F.lit(FILTER_BITS)))).alias("bit")), FILTER_BITS)


class _Screen:
    """Whether a term may be in the bitmap; answers are kept for a bounded number of words."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.known = bits, {}

    def __call__(self, word: str) -> bool:
        if (got := self.known.get(word)) is None:
            import xxhash

            if len(self.known) > 100_000:
                self.known.clear()
            h = xxhash.xxh64_intdigest(word.lower().encode(), 42)
            h -= (h >> 63) << 64
            got = self.known[word] = all(self.bits[b >> 5] >> (b & 31) & 1 for b in (h % FILTER_BITS, (h >> 32) % FILTER_BITS))
        return got


def term_documents(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``(term, term_docs)``: documents that hold a term, for the terms in the bitmap."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(batches):
        screen = _Screen(bits)
        for b in released(batches):
            seen: Counter = Counter()
            for t in b.column("text").to_pylist():
                seen.update({w.lower() for w in set(_TERM.findall(t)) if screen(w)})
            yield out_batch(schema, [list(seen), list(seen.values())])

    return (docs.select(text_or_empty().alias("text")).mapInArrow(run, "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("term_docs")))


def disclosing_terms(docs: DataFrame, contexts: int = CONTEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """``(term, disclosure)`` of the terms above the threshold: the highest over all entities (stored)."""
    n = docs.count()
    joint = entity_contexts(docs).filter((F.col("contexts") >= contexts) & (F.col("fresh") >= FRESH))
    counts = term_documents(docs, term_bitmap(joint.select("term").distinct()))
    scored = joint.join(counts, "term").join(entity_documents(docs), "entity").filter(F.col("entity_docs") < n)
    ic = -F.log2(F.col("entity_docs") / F.lit(n))
    pmi = F.log2(F.col("docs") * F.lit(n) / (F.col("entity_docs") * F.col("term_docs")))
    best = scored.groupBy("term").agg(F.max(pmi / ic).alias("disclosure"))
    return materialise(best.filter(F.col("disclosure") >= threshold), "pii-terms")


_FOUND = "start int, kind int, end int"


def find_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(row, doc_id, text_hash, base, spans, gone)``: sorted arrays of ``(start, kind, end)`` for every document.

    ``gone``: where the spans start whose term has disclosure 1 (if ``terms`` has ``disclosure``).
    """
    bits = term_bitmap(terms.select("term"))
    only = F.col("disclosure") >= 1 - 1e-9 if "disclosure" in terms.columns else F.lit(False)
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    hit = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("base", span), ("hits", hit)])
    any_bit = bool(bits.any())

    def run(batches):
        screen = _Screen(bits)
        for b in released(batches):
            base, hits = [], []
            for t in b.column("text").to_pylist():
                spans = base_spans(t)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                found = []
                if any_bit and any(screen(w) for w in set(_TERM.findall(t))):
                    covered = [(s, e) for s, _, e in spans]
                    found = [{"term": m.group().lower(), "start": m.start(), "end": m.end()} for m in _TERM.finditer(t)
                             if screen(m.group()) and not any(s <= m.start() < e for s, e in covered)]
                hits.append(found)
            yield out_batch(schema, [b.column("doc_id"), b.column("text_hash"), base, hits])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = rows.mapInArrow(run, f"doc_id long, text_hash long, base array<struct<{_colon(_FOUND)}>>, hits array<struct<term: string, start: int, end: int>>")
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "pii-spans")  # stored, so row numbers stay
    named = found.filter(F.size("hits") > 0).select("row", F.inline("hits")).join(terms.select("term", only.alias("only")), "term")
    named = named.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")).alias("terms"),
                                     F.collect_list(F.when(F.col("only"), F.col("start"))).alias("gone"))  # a document's own
    return found.join(named, "row", "left").select(
        "row", "doc_id", "text_hash", "base",
        F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "terms"))).alias("spans"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def _colon(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split() for c in ddl.split(", ")))


def spans_text(col: str):
    """``kind:start:end`` of the spans, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(col), lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they were, with the marked spans of ``text`` generalised or removed.

    Where spans overlap the first one's label stands for all of them.
    """
    doc, key, text_hash, marks = unused(docs, "pii_doc", "pii_key", "pii_hash", "pii_marks")
    found = find_spans(docs, disclosing_terms(docs)).filter(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash)).agg(F.first(F.struct("spans", "gone")).alias(marks))
    keyed = docs.withColumn(key, F.xxhash64(text_or_empty()))
    joined = keyed.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text_hash)), "left")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for b in released(batches):
            texts = b.column(at).to_pylist()
            for i, mark in enumerate(b.column(len(names)).to_pylist()):
                if mark:
                    texts[i] = _replace(texts[i], mark["spans"], set(mark["gone"]))
            cols = [pa.array(texts, pa.string()) if j == at else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.drop(doc, text_hash, key).mapInArrow(run, docs.schema)


def _replace(text: str, spans: list[dict], gone: set[int]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], "" if s["kind"] == 4 and s["start"] in gone else f"[{KINDS[s['kind']].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def _count(col: str, kind: int):
    return F.size(F.filter(col, lambda s: s["kind"] == kind)).cast("long")


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, disclosing_terms(docs).select("term"))
    counts = [_count("base", k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_term"))
