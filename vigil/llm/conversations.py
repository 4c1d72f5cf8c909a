"""Conversation structure repair: cheapest edits by dynamic programming over a Re-Pair grammar.

Every row becomes one of 16 symbols: the initial of its role (s, u, a, other) and its first
fault (none, blank, duplicate, truncated). A legal conversation has the role initials
``(s?(ua)+)?``: four states, after nothing, s, u and a.

1. Rows are reduced to their keys, copies summed, and sorted by conversation and turn over the
   whole cluster; each partition cuts its stretch into chunks of at most ``CHUNK`` symbols.
2. Re-Pair: each round counts the neighbouring pairs of all chunks (equal chunks once, times
   their number) and names the most frequent ones that share no symbol, until ``RULES`` rules
   or ``ROUNDS`` rounds; what no rule covers stays a symbol.
3. A rule has one min-plus matrix: the least cost from any state before to any state after,
   with the two ropes it is joined from. It is evaluated bottom-up from the matrices of its two
   symbols, once, and shared by all conversations. Chunks fold the matrices of what is left.
4. One task streams a conversation: its chunks' matrices, then its rows in order, which are
   edited as the audit says.

Ties. Of equal costs the ASCII-least string of edit initials wins. Strings from one state over
the same rows never are prefixes of each other (each ends with the edit of its last row, inserts
come before it) and none leads to two states. So their order is that of their first
difference, and matrices carry, for each state before, the rank of the strings to each state
after. Costs and ranks alone then decide every tie, and ropes are only spelled out for the answer.

Scale: a conversation with very many rows is spread by turn in steps 1 to 3. Step 4 has two bytes a
row of the conversation in memory (symbols, and the audit, which is one value of the result);
its texts stream through, since SHA-256 has no parallel form.

Rows are taken by turn, nulls first; rows of one turn by role, then by text (its first ``HEAD``
characters, then its MD5); equal rows are copies. Null role or text counts as one space. A null
``conv_id`` is a conversation of its own, as are all rows with it. An empty role has no initial
and can't be kept. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import materialise, partitions, small_batches, table

CHUNK, RULES, ROUNDS, HEAD = 4096, 256, 10, 64
ROLES, FAULTS = "sua", ["ok", "blank", "duplicate", "truncated"]
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States after nothing, s, u, a. The state after keeping s, u or a (none: not legal there), and after a role that edits choose.
_KEPT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_CHOSEN = [2, 2, 3, 2]
_ROLE_OF = [None, None, "user", "assistant"]
_NEVER = 1 << 40
_FIRST, _RULE = ord("A"), 0x100


class Grammar:
    """Rules ``(left, right)`` of symbols, their matrices and ropes; a rule's symbol is a character from ``_RULE`` on.

    ``cost[x][p, q]`` and ``rank[x][p, q]`` belong to symbol x between states p and q.
    ``sums[x]`` is (blank, duplicate, truncated, illegal neighbours, first role, last role).
    """

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.cost, self.rank, self.sums, self.rope = {}, {}, {}, {}
        for k in range(16):
            self._terminal(chr(_FIRST + k), (ROLES + "?")[k // 4], k % 4)
        for k, (x, y) in enumerate(rules):
            z = chr(_RULE + k)
            self.cost[z], self.rank[z], self.rope[z] = joined(self.cost[x], self.rank[x], self.cost[y], self.rank[y])
            self.sums[z] = add_sums(self.sums[x], self.sums[y])
        self.spelled = lru_cache(maxsize=1 << 12)(self._spell)

    def _terminal(self, x: str, role: str, fault: int) -> None:
        best = {}
        for p in range(4):
            state, inserts = p, 0
            while inserts < 4:
                ways = [("D", DELETE, state)]
                if FAULTS[fault] in ("ok", "truncated"):
                    more = TRUNCATED if FAULTS[fault] == "truncated" else 0
                    ways += [("K", KEEP + more, _KEPT[state].get(role)), ("R", REROLE + more, _CHOSEN[state])]
                for edit, cost, q in ways:
                    if q is not None:
                        best[p, q] = min(best.get((p, q), (_NEVER, "")), (INSERT * inserts + cost, "I" * inserts + edit))
                state, inserts = _CHOSEN[state], inserts + 1
        self.cost[x] = np.array([[best.get((p, q), (_NEVER, ""))[0] for q in range(4)] for p in range(4)])
        self.rank[x] = np.array([[sum(best[p, r][1] < best[p, q][1] for r in range(4) if (p, r) in best) if (p, q) in best else 3 for q in range(4)] for p in range(4)])
        self.rope[x] = {at: text for at, (_, text) in best.items()}
        self.sums[x] = (int(fault == 1), int(fault == 2), int(fault == 3), 0, role, role)

    def compressed(self, symbols: str) -> str:
        return compressed(self.rules, symbols)

    def folded(self, symbols: str) -> tuple[np.ndarray, np.ndarray, tuple, list[np.ndarray]]:
        """Cost, rank, sums and the middle states of every join of the whole string, from the left."""
        first, *rest = symbols
        cost, rank, sums, middles = self.cost[first], self.rank[first], self.sums[first], []
        for x in rest:
            cost, rank, middle = joined(cost, rank, self.cost[x], self.rank[x])
            middles.append(middle)
            sums = add_sums(sums, self.sums[x])
        return cost, rank, sums, middles

    def _spell(self, x: str, p: int, q: int) -> str:
        if ord(x) < _RULE:
            return self.rope[x][p, q]
        left, right = self.rules[ord(x) - _RULE]
        middle = int(self.rope[x][p, q])
        return self.spelled(left, p, middle) + self.spelled(right, middle, q)

    def audit(self, symbols: str, p: int, q: int) -> str:
        """Edit initials of the cheapest way through ``symbols`` (not compressed) between two states."""
        short, out = self.compressed(symbols), []
        middles = self.folded(short)[3]
        for k in range(len(short) - 1, 0, -1):
            middle = int(middles[k - 1][p, q])
            out.append(self.spelled(short[k], middle, q))
            q = middle
        return self.spelled(short[0], p, q) + "".join(reversed(out))


def compressed(rules: list[str], symbols: str) -> str:
    for k, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(_RULE + k))
    return symbols


def joined(cost_a, rank_a, cost_b, rank_b):
    """``(cost, rank, middle)`` of two stretches in a row: min-plus product, ties by the first stretch's rank."""
    weight = (cost_a[:, :, None] + cost_b[None]) * 4 + rank_a[:, :, None]
    middle = weight.argmin(1)
    p, q = np.arange(4)[:, None], np.arange(4)[None]
    cost = np.minimum(cost_a[p, middle] + cost_b[middle, q], _NEVER)
    order = (rank_a[p, middle] * 4 + rank_b[middle, q] + 16 * (cost >= _NEVER)).argsort(1, kind="stable")
    rank = np.empty((4, 4), np.int64)
    np.put_along_axis(rank, order, np.arange(4)[None].repeat(4, 0), 1)
    return cost, rank, middle


def add_sums(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3] + (a[5] + b[4] not in ("su", "ua", "au")), a[4], b[5]


def _nulls_as_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows ``(conv_id, turn, role, text, copies)`` after damage by the CRC-32 of ``conv_id:turn``, mod 20."""
    way = F.crc32(F.encode(F.concat(_nulls_as_space("conv_id"), F.lit(":"), _nulls_as_space("turn")), "UTF-8")) % 20
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", _nulls_as_space("role").alias("role"), _nulls_as_space("text").alias("text"), way.alias("way"))
    return rows.filter("way > 0").select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                         F.when(F.col("way") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.substring("text", 1, HEAD), "digest": F.md5(F.encode("text", "UTF-8"))})


ORDER = ["turn", "role", "head", "digest"]


def chunks(rows: DataFrame) -> DataFrame:
    """``(conv_id, part, no, symbols)``: all rows as symbols, in the order of (part, no) in each conversation (stored)."""
    spark = rows.sparkSession
    blank = F.length(F.translate("text", SPACE, "")) == 0
    cut = ~F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1).isin(*STOPS)
    keys = _keyed(rows).select("conv_id", *ORDER, blank.alias("blank"), cut.alias("cut"), "copies")
    keys = keys.groupBy("conv_id", *ORDER, "blank", "cut").agg(F.sum("copies").alias("copies"))
    # The first row of a role and text has the least turn among all with them; a turn has it once, copies aside.
    first = keys.filter("not blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("least"))
    first = first.select(F.struct("conv_id", "role", "digest", F.col("least.turn").alias("turn")).alias("at"))
    keys = keys.join(first, F.struct("conv_id", "role", "digest", "turn").eqNullSafe(first["at"]), "left")

    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12)
    fault = F.when(F.col("blank"), 1).when(F.col("at").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    again = F.when(F.col("blank"), 1).otherwise(2)
    keys = keys.select("conv_id", *ORDER, "copies", F.char(role + fault + _FIRST).alias("x"), F.char(role + again + _FIRST).alias("y"))
    # Very many copies are several pieces, so that none is longer than a chunk.
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}")))
    keys = keys.withColumn("piece", piece).withColumn("many", F.least(F.lit(CHUNK), F.col("copies") - CHUNK * F.col("piece")).cast("int"))
    symbols = F.when(F.col("piece") == 0, F.concat("x", F.repeat("y", F.col("many") - 1))).otherwise(F.repeat("y", F.col("many")))
    dealt = keys.select("conv_id", *ORDER, "piece", symbols.alias("symbols")).repartitionByRange(partitions(spark), "conv_id", *ORDER, "piece")

    def run(batches):
        part, conv, no, held, size = TaskContext.get().partitionId(), None, 0, [], 0
        out = []

        def flush():
            nonlocal held, size, no
            if held:
                out.append((conv, part, no, "".join(held)))
                held, size, no = [], 0, no + 1

        for b in batches:
            for c, s in zip(b.column("conv").to_pylist(), b.column("symbols").to_pylist()):
                if c != conv or size + len(s) > CHUNK:
                    flush()
                conv = c
                held.append(s)
                size += len(s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    types, names = [pa.string(), pa.int32(), pa.int64(), pa.string()], ["conv", "part", "no", "symbols"]
    in_order = dealt.sortWithinPartitions("conv_id", *ORDER, "piece").select(F.col("conv_id").cast("string").alias("conv"), "symbols")
    return materialise(in_order.mapInArrow(run, "conv string, part int, no long, symbols string"), "conv-chunks")


def grammar(chunked: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over all chunks: at most ``rules`` pairs reach the driver in each of at most ``rounds`` rounds."""
    shapes = materialise(chunked.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "conv-shapes")
    found: list[str] = []
    for _ in range(rounds):

        def run(batches, now=found):
            seen = Counter()
            for b in batches:
                for s, n in zip(b.column("symbols").to_pylist(), b.column("n").to_pylist()):
                    s = compressed(now, s)
                    for (x, y), k in Counter(zip(s, s[1:])).items():
                        seen[x + y] += n * (s.count(x + y) if x == y else k)  # pairs of equal symbols don't overlap
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pair", "n"])

        counted = shapes.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
        used, more = set(), []
        for r in counted.orderBy(F.desc("n"), "pair").limit(rules).collect():
            if not used & set(r.pair) and len(found) + len(more) < rules:
                used |= set(r.pair)
                more.append(r.pair)
        if not more:
            break
        found = found + more
    return Grammar(found)


def _evaluated(chunked: DataFrame, rules: list[str]) -> DataFrame:
    """Chunks with the matrix of their costs and ranks, and their sums."""

    def run(batches):
        g = Grammar(rules)

        @lru_cache(maxsize=1 << 14)
        def one(symbols: str):
            cost, rank, sums, _ = g.folded(g.compressed(symbols))
            return [*cost.ravel().tolist(), *rank.ravel().tolist(), *sums[:4]], sums[4] + sums[5]

        for b in batches:
            got = [one(s) for s in b.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m for m, _ in got], pa.list_(pa.int64())), pa.array([e for _, e in got], pa.string())],
                                             names=["conv", "part", "no", "symbols", "matrix", "ends"])

    return chunked.mapInArrow(run, "conv string, part int, no long, symbols string, matrix array<long>, ends string")


class _Walk:
    """One conversation: chunks, then rows, give the audit and the repaired rows."""

    def __init__(self, conv, gaps: int, g: Grammar):
        self.conv, self.gaps, self.g = conv, gaps, g
        self.cost, self.rank = np.array([0] + [_NEVER] * 3), np.arange(4)
        self.sums, self.path, self.audit = None, [], None
        self.hash, self.place, self.state, self.at = hashlib.sha256(), 0, 0, 0

    def chunk(self, symbols: str, matrix: list[int], ends: str) -> None:
        m = np.array(matrix[:32]).reshape(2, 4, 4)
        middle = ((self.cost[:, None] + m[0]) * 4 + self.rank[:, None]).argmin(0)
        q = np.arange(4)
        cost = np.minimum(self.cost[middle] + m[0][middle, q], _NEVER)
        order = (self.rank[middle] * 4 + m[1][middle, q] + 16 * (cost >= _NEVER)).argsort(kind="stable")
        self.cost, self.rank = cost, order.argsort()
        self.path.append((symbols, middle.astype(np.int8)))
        sums = (*matrix[32:], ends[0], ends[1])
        self.sums = sums if self.sums is None else add_sums(self.sums, sums)

    def decide(self) -> None:
        """The audit, once all chunks are known."""
        close = np.array([0, 2 * INSERT, INSERT, 0])
        total = self.cost + close
        q = int((total * 4 + self.rank).argmin())
        self.total, out = int(total[q]), ["I" * (int(close[q]) // INSERT)]
        for symbols, middle in reversed(self.path):
            p = int(middle[q])
            out.append(self.g.audit(symbols, p, q))
            q = p
        self.audit, self.path = "".join(reversed(out)), []

    def _emit(self, role: str, text: str, edit: str, out: list | None) -> None:
        self.hash.update((b"\n" if self.place else b"") + f"{role}:{text}".encode())
        if out is not None:
            out.append((self.conv, self.place, edit, role, text))
        self.place += 1

    def _inserts(self, out: list | None) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = _CHOSEN[self.state], self.at + 1
            self._emit(_ROLE_OF[self.state], "", "I", out)

    def row(self, role: str, text: str, copies: int, out: list | None) -> None:
        if self.audit is None:
            self.decide()
        for _ in range(copies):
            self._inserts(out)
            edit, self.at = self.audit[self.at], self.at + 1
            if edit != "D":
                self.state = _KEPT[self.state][role[0]] if edit == "K" else _CHOSEN[self.state]
                self._emit(role if edit == "K" else _ROLE_OF[self.state], text, edit, out)

    def end(self, out: list | None) -> tuple:
        if self.audit is None:
            self.decide()
        self._inserts(out)
        blank, duplicate, truncated, illegal = self.sums[:4] if self.sums else (0, 0, 0, 0)
        return self.conv, self.gaps, blank, duplicate, truncated, illegal, self.total, self.audit, self.hash.hexdigest()


AUDIT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
REPAIRED = {"place": "long", "edit": "string", "role": "string", "text": "string"}


def _walked(rows: DataFrame, conversations: DataFrame, repaired: bool) -> DataFrame:
    """Audits of all ``conversations`` (distinct ``conv_id``), or the repaired rows."""
    spark = rows.sparkSession
    small_batches(spark)
    chunked = chunks(rows)
    rules = grammar(chunked).rules
    turns = rows.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("one")).alias("gaps"))
    turns = turns.unionByName(conversations.select("conv_id", F.lit(None).cast("long").alias("gaps"))).groupBy("conv_id").agg(F.coalesce(F.max("gaps"), F.lit(0)).alias("gaps"))
    form = "conv string, kind int, part int, no long, turn long, role string, head string, digest string, gaps long, symbols string, matrix array<long>, ends string, text string, copies long"

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        fields = [f.split() for f in form.split(", ")]
        return df.withColumn("kind", F.lit(kind)).select(*((F.col(n) if n in df.columns or n == "kind" else F.lit(None)).cast(t).alias(n) for n, t in fields))

    texts = _keyed(rows).withColumn("conv", F.col("conv_id").cast("string"))
    whole = shaped(turns.withColumn("conv", F.col("conv_id").cast("string")), 0).unionByName(shaped(_evaluated(chunked, rules), 1)).unionByName(shaped(texts, 2))
    dealt = whole.repartition(partitions(spark), "conv").sortWithinPartitions("conv", "kind", "part", "no", *ORDER)

    names = ["conv", *(REPAIRED if repaired else AUDIT)]
    types = [{"string": pa.string(), "long": pa.int64()}[t] for t in ["string", *(REPAIRED if repaired else AUDIT).values()]]

    def run(batches):
        g, walk = Grammar(rules), None
        for b in batches:
            out, ended = ([] if repaired else None), []
            cols = {n: b.column(n).to_pylist() for n in ("conv", "kind", "gaps", "symbols", "matrix", "ends", "role", "text", "copies")}
            for conv, kind, gaps, symbols, matrix, ends, role, text, copies in zip(*cols.values()):
                if kind == 0:  # each conversation begins with this row
                    if walk is not None:
                        ended.append(walk.end(out))
                    walk = _Walk(conv, gaps, g)
                elif kind == 1:
                    walk.chunk(symbols, matrix, ends)
                else:
                    walk.row(role, text, copies, out)
            for found in [out if repaired else ended]:
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names=names)
        out = [] if repaired else None
        ended = [walk.end(out)] if walk is not None else []
        found = out if repaired else ended
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names=names)

    schema = ", ".join(f"{n} {t}" for n, t in [("conv", "string"), *(REPAIRED if repaired else AUDIT).items()])
    as_was = conversations.schema["conv_id"].dataType
    return dealt.drop("part", "no", "turn", "head", "digest").mapInArrow(run, schema).withColumn("conv", F.col("conv").cast(as_was)).withColumnRenamed("conv", "conv_id")


def audits(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Faults, gaps, least cost, edits and the digest of the repaired text of each conversation.

    ``rows`` as from ``damaged`` (with ``copies``); ``conversations`` names those that must be
    reported, rows or not.
    """
    return _walked(rows, conversations.select("conv_id").distinct(), False)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows ``(conv_id, place, edit, role, text)``, inserted ones with them, deleted ones without."""
    return _walked(rows, rows.select("conv_id").distinct(), True)


def op13_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure audit and repair of all damaged conversations."""
    conversations = table(spark, sf_dir, "conversations")
    return audits(damaged(conversations), conversations)
