"""Source divergence audit: how the word use of each source departs from its language, by count cells.

1. Terms are counted per (lang, source, term), with the documents that hold them, and summed
   before the shuffle. A language keeps the terms of at least ``min_docs`` of its documents.
2. Part ``term``: f of a term depends only on its count in the group and in the language. So
   terms are grouped into cells (group count, lang count), f is evaluated once a cell, cells of
   equal f are merged, and only the values that the cumulative multiplicity still needs for
   ``top`` ranks are expanded into terms, in UTF-8 order.
3. Part ``pair``: groups are numbered within their language and dealt in tiles of ``TILE``. A
   task sees the counts of some terms for two tiles and adds up |p - q| as matrices; terms that
   neither group has add the same |base - base| each and are never spelled out.

All arithmetic is on integers: the division is long division in three steps of a thousand, so
nothing overflows below 9e15 occurrences.

Scale: rows are pre-aggregated in the task that reads them; a frequent term has one row a task,
a hot group is many terms, dealt by term. Ranks keep ``top`` rows of each group before the
shuffle. Pairs of groups are the result itself; no term is paired with another.

Null ``text``, ``lang`` and ``source`` count as ''. Empty texts and texts without terms still
make their group occur. Ties rank by the item's UTF-8 bytes. Repeated rows count as documents.
A language that keeps no term has values of 0. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import materialise, partitions, small_batches, table

MIN_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Groups of a language compared at once in a task: its sums take ``TILE`` squared numbers.
TILE = 256
#: Parts into which the terms of two tiles are dealt; each gives one partial sum a pair.
SALTS = 16
#: Terms in a matrix at once.
_TERMS = 1024
#: A-Z lowered, other ASCII that is no letter made a space; bytes of other characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _terms(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts and the number of the text of each."""
    _, offsets, data = texts.buffers()
    clean = data.to_pybytes().translate(_LETTERS) if data is not None else b""
    cut = pc.ascii_split_whitespace(type(texts).from_buffers(len(texts), offsets, pa.py_buffer(clean), None, 0, texts.offset))
    flat = cut.flatten()
    text = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    real = pc.binary_length(flat).to_numpy() > 0  # Arrow gives empty pieces at the ends of a text
    return flat.filter(pa.array(real)).dictionary_encode(), text[real]


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents with the term."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            terms, text = _terms(b.column("text"))
            lang, source = b.column("lang").dictionary_encode(), b.column("source").dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
            width = max(len(terms.dictionary), 1)
            once, n = np.unique(text * width + terms.indices.to_numpy(), return_counts=True)
            at, back = np.unique(group[once // width] * width + once % width, return_inverse=True)
            pair = at // width
            yield pa.RecordBatch.from_arrays([
                lang.dictionary.take(pa.array(pair // max(len(source.dictionary), 1))), source.dictionary.take(pa.array(pair % max(len(source.dictionary), 1))),
                terms.dictionary.take(pa.array(at % width)), pa.array(np.bincount(back, n, len(at)).astype(np.int64)),
                pa.array(np.bincount(back, minlength=len(at)).astype(np.int64))], names=["lang", "source", "term", "n", "docs"])

    rows = _groups(docs, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), *more)


def share(count: str, total: str, kept: str) -> Column:
    """``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept))`` exactly, a thousand at a time."""
    whole, left, by = "0L", f"({count} + {PRIOR})", f"({total} + {PRIOR} * {kept})"
    for _ in range(3):
        whole, left = f"({whole} * 1000 + ({left} * 1000) div {by})", f"(({left} * 1000) % {by})"
    return F.expr(f"1 + {whole}")


def _pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, g, h, more)``: by how much |p - q| over the terms of g or h exceeds that of terms that neither has.

    ``groups`` has the number ``at`` of each group in its language; ``g`` and ``h`` are such numbers.
    """
    spark, salts = kept.sparkSession, SALTS
    tiles = groups.groupBy("lang").agg((F.max("at") / TILE).cast("int").alias("last"))
    numbered = groups.join(tiles, "lang").filter("kept > 0").withColumn("tile", (F.col("at") / TILE).cast("int"))
    numbered = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    numbered = numbered.select("lang", "source", "at", "n_group", "kept", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    base = numbered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        "lang", "a", "b", "salt", F.lit(None).cast("string").alias("term"), "at", share("0L", "n_group", "kept").alias("p"))
    held = kept.join(numbered, ["lang", "source"]).select(
        "lang", "a", "b", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt"), "term", "at", share("n", "n_group", "kept").alias("p"))
    key = ["lang", "a", "b", "salt"]

    class Sums:
        """Sums of one bucket: the base rows come first, then the terms."""

        def __init__(self, bucket):
            self.lang, self.a, self.b, _ = bucket
            self.base, self.sum = np.full(2 * TILE, -1, np.int64), np.zeros((TILE, TILE), np.int64)

        def add(self, first: np.ndarray, at: np.ndarray, p: np.ndarray, is_base: bool) -> None:
            place = np.where(at // TILE == self.a, 0, TILE) + at % TILE
            if is_base:
                self.base[place] = p
                return
            left, right = self.base[:TILE], self.base[:TILE] if self.a == self.b else self.base[TILE:]
            term = np.cumsum(first) - 1
            for t in range(0, int(term[-1]) + 1, _TERMS):
                rows = slice(*np.searchsorted(term, [t, t + _TERMS]))
                many = int(term[rows][-1]) - t + 1
                matrix = np.repeat(self.base[None], many, 0)
                matrix[term[rows] - t, place[rows]] = p[rows]
                other = matrix[:, :TILE] if self.a == self.b else matrix[:, TILE:]
                for g in np.flatnonzero(left >= 0):
                    self.sum[g] += np.abs(other - matrix[:, g:g + 1]).sum(0) - many * np.abs(right - left[g])

        def rows(self) -> pa.RecordBatch:
            right = self.base[:TILE] if self.a == self.b else self.base[TILE:]
            g, h = np.nonzero((self.sum != 0) & (self.base[:TILE] >= 0)[:, None] & (right >= 0))
            more, g, h = self.sum[g, h], self.a * TILE + g, self.b * TILE + h
            if self.a != self.b:
                g, h, more = np.concatenate([g, h]), np.concatenate([h, g]), np.concatenate([more, more])
            return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(g), pa.string()), pa.array(g.astype(np.int32)),
                                               pa.array(h.astype(np.int32)), pa.array(more)], names=["lang", "g", "h", "more"])

    def run(batches):
        now = None  # the bucket that is being summed
        held_back = None  # rows of the last term, which may go on in the next batch

        def take(t: pa.Table):
            """Add the rows of whole terms; yields the buckets that ended."""
            nonlocal now
            codes = [t.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "a", "b", "salt")]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)])
            terms = t.column("term").combine_chunks()
            is_base = terms.is_null().to_numpy(zero_copy_only=False)
            word = terms.fill_null("").dictionary_encode().indices.to_numpy()
            change = new | np.concatenate([[True], (word[1:] != word[:-1]) | (is_base[1:] != is_base[:-1])])
            part = np.flatnonzero(new | np.concatenate([[True], is_base[1:] != is_base[:-1]]))
            at, p = t.column("at").to_numpy(), t.column("p").to_numpy()
            for s, e in zip(part, np.append(part[1:], len(t))):
                bucket = tuple(t.column(c)[s].as_py() for c in ("lang", "a", "b", "salt"))
                if now is None or now[0] != bucket:
                    if now is not None:
                        yield now[1].rows()
                    now = (bucket, Sums(bucket))
                now[1].add(change[s:e], at[s:e], p[s:e], bool(is_base[s]))

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held_back is None else pa.concat_tables([held_back, t])
            if not len(t):
                continue
            last, word = t.slice(len(t) - 1), t.column("term")
            cut = len(t)
            if last.column("term")[0].is_valid:
                same = pc.fill_null(pc.equal(word, last.column("term")[0]), False).to_numpy()
                for c in ("lang", "a", "b", "salt"):
                    same &= pc.equal(t.column(c), last.column(c)[0]).to_numpy()
                cut = int(np.flatnonzero(same)[0])
            if cut:
                yield from take(t.slice(0, cut))
            held_back = t.slice(cut) if cut < len(t) else None
        if held_back is not None:
            yield from take(held_back)
        if now is not None:
            yield now[1].rows()

    small_batches(spark)
    dealt = base.unionByName(held).repartition(partitions(spark), *key).sortWithinPartitions(*key, "term")
    return dealt.mapInArrow(run, "lang string, g int, h int, more long").groupBy("lang", "g", "h").agg(F.sum("more").alias("more"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: other sources by distance, and the terms a source has too often."""
    counts = materialise(term_counts(docs), "div-counts")
    vocab = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang_term"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = materialise(counts.select("lang", "source", "term", "n").join(vocab.drop("docs"), ["lang", "term"]), "div-kept")
    # Sums of the languages from their terms once each: a term has the same row in every group that holds it.
    langs = kept.groupBy("lang", "term").agg(F.first("n_lang_term").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("n_lang"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = _groups(docs).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n_group", "kept", "n_lang"])
    groups = materialise(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "div-groups")

    cells = kept.groupBy("lang", "source", "n", "n_lang_term").agg(F.count(F.lit(1)).alias("m")).join(groups, ["lang", "source"])
    cells = cells.withColumn("value", share("n", "n_group", "kept") - share("n_lang_term", "n_lang", "kept")).filter("value > 0")
    cells = materialise(cells.select("lang", "source", "n", "n_lang_term", "value", "m"), "div-cells")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m")).withColumn("at", F.row_number().over(by_value)).filter(F.col("at") <= top)
    before = F.coalesce(F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = merged.withColumn("before", before).filter(F.col("before") < top).select("lang", "source", "value", "before")
    needed = cells.join(needed, ["lang", "source", "value"]).select("lang", "source", "n", "n_lang_term", "value", "before")
    in_order = Window.partitionBy("lang", "source", "value").orderBy("term")
    terms = kept.join(needed, ["lang", "source", "n", "n_lang_term"]).withColumn("place", F.row_number().over(in_order)).filter(F.col("place") <= top)
    terms = terms.withColumn("rank", (F.col("before") + F.col("place")).cast("int")).filter(F.col("rank") <= top)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    one = groups.withColumn("base", F.when(F.col("kept") > 0, share("0L", "n_group", "greatest(kept, 1L)"))).select("lang", "source", "at", "kept", "base")
    two = one.select("lang", F.col("source").alias("item"), F.col("at").alias("h"), F.col("base").alias("base_h"))
    pairs = one.withColumnRenamed("at", "g").join(two, "lang").filter("g != h").join(_pair_sums(kept, groups), ["lang", "g", "h"], "left")
    value = F.when(F.col("kept") > 0, F.col("kept") * F.abs(F.col("base") - F.col("base_h")) + F.coalesce("more", F.lit(0))).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the 50 terms that mark each source, over all documents."""
    return divergence(table(spark, sf_dir, "documents"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _share_sql(count: str, total: str, kept: str) -> str:
    return f"(1 + ({SCALE}::HUGEINT * ({count} + {PRIOR})) // ({total} + {PRIOR} * {kept}))"


#: The same by SQL, terms and all: every pair of sources over every kept term.
ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
occ AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
vocab AS (SELECT lang, term, count(*) AS n_lang_term FROM occ GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS kept, sum(n_lang_term) AS n_lang FROM vocab GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN vocab USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS n_group FROM counts GROUP BY lang, source),
groups AS (SELECT lang, source, coalesce(n_group, 0) AS n_group, coalesce(kept, 0) AS kept, coalesce(n_lang, 0) AS n_lang
           FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)),
probs AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, {_share_sql('coalesce(c.n, 0)', 'g.n_group', 'g.kept')} AS p,
                 {_share_sql('v.n_lang_term', 'g.n_lang', 'g.kept')} AS q
          FROM groups g JOIN vocab v USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term
          WHERE a.source <> b.source GROUP BY ALL),
listed AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
           LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
           UNION ALL SELECT lang, source, 'term', term, p - q FROM probs WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM listed)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
