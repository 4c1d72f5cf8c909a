"""Skew-safe keyed scans.

A plain ``Window.partitionBy(series).orderBy(ts)`` puts a whole series into one task; a
single hot series (a third of all rows) then serialises the job. Every scan here
partitions by ``(key, time bucket)`` instead and repairs the bucket edges with a small
per-bucket summary table (one row per key and bucket, so its size grows with the
time span, not with the row count). Results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Width of the time buckets used to split one key's rows across tasks, in the unit of the order
# column. Pass a width that suits it for other units (line numbers) or very dense keys.
DEFAULT_BUCKET_US = 600_000_000  # 10 min
#: Events that one task of the as-of scan sorts (with as many probes).
ASOF_ROWS = 100_000


def composite_key(cols: Sequence[str]) -> Column:
    """Null-safe single string key over several columns (joins on it are plain equi-joins)."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in cols])


def _edge_join(d: DataFrame, summary: DataFrame, keys: list[str], col: str) -> DataFrame:
    cond = [d[k].eqNullSafe(summary[k]) for k in keys] + [d["_bk"] == summary["_bk"]]
    return d.join(summary, cond, "left").select(d["*"], summary[col])


def keyed_lag(df: DataFrame, keys: Sequence[str], ts: str, tie: str, cols: Sequence[str],
              bucket_us: int = DEFAULT_BUCKET_US, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` (and ``prev_<ts>``) = value of the previous row of the same key in
    ``(ts, tie)`` order. ``ts`` is BIGINT micro-seconds and must be non-null.

    One window pass over ``(key, bucket)`` gives the in-bucket lag and marks each bucket's
    last row (``lead`` is null); those tails, lagged over the small per-key bucket list,
    supply the first row of the next non-empty bucket."""
    keys = list(keys)
    cols = list(cols)
    carry = [ts, tie] + [c for c in cols if c not in (ts, tie)]
    d = df.withColumn("_bk", F.floor(F.col(ts) / F.lit(bucket_us)).cast("bigint"))
    w = Window.partitionBy(*keys, "_bk").orderBy(ts, tie)
    d = (d.withColumn("_inb", F.lag(F.struct(*carry)).over(w))
         .withColumn("_last", F.lead(F.col(ts)).over(w).isNull()))
    tails = d.filter("_last").select(*keys, "_bk", F.struct(*carry).alias("_tail"))
    wt = Window.partitionBy(*keys).orderBy("_bk")
    tails = tails.select(*keys, "_bk", F.lag("_tail").over(wt).alias("_carry"))
    j = _edge_join(d, tails, keys, "_carry")
    prev = F.coalesce(F.col("_inb"), F.col("_carry"))
    out = j
    for c in [ts] + [c for c in cols if c != ts]:
        out = out.withColumn(prefix + c, prev[c])
    return out.drop("_inb", "_carry", "_bk", "_last")


def keyed_running_sums(df: DataFrame, keys: Sequence[str], ts: str, tie: str, cols: Sequence[str],
                       bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Several running sums over the same key and order in one pass (each column replaced
    by its inclusive running sum)."""
    keys = list(keys)
    cols = list(cols)
    d = df.withColumn("_bk", F.floor(F.col(ts) / F.lit(bucket_us)).cast("bigint"))
    w = Window.partitionBy(*keys, "_bk").orderBy(ts, tie)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = d.groupBy(*keys, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])  # combined before the shuffle
    for c in cols:
        d = d.withColumn(c, F.sum(c).over(run))
    wt = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_bk", F.struct(*[F.coalesce(F.sum(f"_t_{c}").over(wt), F.lit(0)).alias(c)
                                              for c in cols]).alias("_off"))
    j = _edge_join(d, tot, keys, "_off")
    for c in cols:
        j = j.withColumn(c, F.col(c) + F.coalesce(F.col("_off")[c], F.lit(0)))
    return j.drop("_bk", "_off")


def keyed_running_sum(df: DataFrame, keys: Sequence[str], ts: str, tie: str, col: str, out: str,
                      bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Running (inclusive) sum of ``col`` per key in ``(ts, tie)`` order, split by time bucket:
    local running sums per (key, bucket), plus the prefix of earlier bucket totals (over the
    small per-key bucket list)."""
    keys = list(keys)
    d = df.withColumn("_bk", F.floor(F.col(ts) / F.lit(bucket_us)).cast("bigint"))
    w = Window.partitionBy(*keys, "_bk").orderBy(ts, tie)
    tot = d.groupBy(*keys, "_bk").agg(F.sum(col).alias("_tot"))  # combined before the shuffle
    d = d.withColumn("_loc", F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wt = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_bk", F.coalesce(F.sum("_tot").over(wt), F.lit(0)).alias("_off"))
    j = _edge_join(d, tot, keys, "_off")
    return (j.withColumn(out, F.col("_loc") + F.coalesce(F.col("_off"), F.lit(0)))
            .drop("_bk", "_loc", "_off"))


def sliding_count(df: DataFrame, keys: Sequence[str], ts: str, tie: str, window_us: int,
                  out: str = "used", block_us: int | None = None) -> DataFrame:
    """Count, for every row, the rows of the same key with ``ts' in [ts - window, ts]`` that
    come at or before it in ``(ts, tie)`` order (a closed sliding window, sequential ties).
    ``(ts, tie)`` must be unique within a key.

    The count is a difference of two ranks: that of the row, and that of its window's start. A
    rank is the number of rows in the blocks before (a running sum over block totals) plus the
    place in its own block. So the rows of one key and window are dealt by blocks of
    ``block_us`` (a sixteenth of the window if none is given), however many they are.
    """
    keys = list(keys)
    block = block_us or max(1, window_us // 16)
    at = df.select(*keys, F.col(ts).alias("_t"), F.col(tie).alias("_i"))
    # A window start goes before the rows of its time: it counts those before the window.
    marks = at.withColumn("_row", F.lit(1)).withColumn("_at", F.col("_t")).unionByName(
        at.withColumn("_row", F.lit(0)).withColumn("_at", F.col("_t") - F.lit(window_us)))
    marks = marks.withColumn("_b", F.floor(F.col("_at") / F.lit(block)).cast("bigint"))
    order = Window.partitionBy(*keys, "_b").orderBy("_at", "_row", "_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = marks.withColumn("_place", F.sum("_row").over(order)).drop("_at")
    totals = marks.groupBy(*keys, "_b").agg(F.sum("_row").alias("_n"))
    totals = keyed_running_sum(totals.withColumn("_tie", F.lit(0)), keys, "_b", "_tie", "_n", "_through", bucket_us=4096)
    totals = totals.select(*(F.col(k).alias(f"_u_{k}") for k in keys), F.col("_b").alias("_tb"), (F.col("_through") - F.col("_n")).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_u_{k}")) for k in keys] + [F.col("_b") == F.col("_tb")]
    ranked = marks.join(totals, same).select(*keys, "_t", "_i", "_row", (F.col("_place") + F.col("_before")).alias("_rank"))
    used = ranked.groupBy(*keys, "_t", "_i").agg(F.sum(F.when(F.col("_row") == 1, F.col("_rank")).otherwise(-F.col("_rank"))).cast("bigint").alias(out))
    used = used.select(*(F.col(k).alias(f"_u_{k}") for k in keys), "_t", "_i", out)
    same = [df[k].eqNullSafe(used[f"_u_{k}"]) for k in keys] + [df[ts] == used["_t"], df[tie] == used["_i"]]
    return df.join(used, same).select(df["*"], out)


def _asof_next(ev: DataFrame, gap_us: int, parts: int | None = None) -> DataFrame:
    """For each event ``(_k, _t, _id)`` return ``_nxt`` = id of the first event of the same key
    with ``_t' > _t + gap`` in ``(_t, _id)`` order (null when none). ``parts``: number of tasks
    that sort the events, the session's if none is given."""
    W = gap_us
    e = ev.select("_k", "_t", "_id", F.floor(F.col("_t") / F.lit(W)).cast("bigint").alias("_bk"))
    probes = e.select("_k", (F.col("_t") + F.lit(gap_us)).alias("_t"), F.col("_id").alias("_src"))
    probes = probes.withColumn("_bk", F.floor(F.col("_t") / F.lit(W)).cast("bigint"))
    # kind 0 = event, 1 = probe. Events at exactly probe time are not "after" it.
    u = (e.select("_k", "_bk", "_t", F.lit(0).alias("_kind"), F.col("_id"), F.lit(None).cast("bigint").alias("_src"))
         .unionByName(probes.select("_k", "_bk", "_t", F.lit(1).alias("_kind"),
                                    F.lit(None).cast("bigint").alias("_id"), "_src")))
    if parts:
        u = u.repartition(parts, "_k", "_bk")
    wdesc = (Window.partitionBy("_k", "_bk").orderBy(F.col("_t").desc(), F.col("_kind").desc(), F.col("_id").desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn("_hit", F.last("_id", ignorenulls=True).over(wdesc)).withColumn("_end", F.lead("_kind").over(wdesc.rowsBetween(1, 1)).isNull())
    inb = u.filter(F.col("_kind") == 1).select("_k", "_bk", "_src", "_hit")
    # Fallback: head of the first non-empty bucket after the probe's bucket.
    heads = u.filter(F.col("_end") & F.col("_hit").isNotNull()).select("_k", "_bk", F.col("_hit").alias("_head"))
    # A bucket is as wide as the gap, so the probes of a bucket's events lie in the next one.
    pb = heads.select("_k", (F.col("_bk") + F.lit(1)).alias("_bk"))
    hb = (heads.select("_k", "_bk", "_head", F.lit(0).alias("_kind"))
          .unionByName(pb.select("_k", "_bk", F.lit(None).cast("bigint").alias("_head"), F.lit(1).alias("_kind"))))
    wb = (Window.partitionBy("_k").orderBy(F.col("_bk").desc(), F.col("_kind").desc())
          .rowsBetween(Window.unboundedPreceding, -1))
    nextb = (hb.withColumn("_after", F.last("_head", ignorenulls=True).over(wb))
             .filter(F.col("_kind") == 1).select("_k", "_bk", "_after"))
    r = inb.join(nextb, ["_k", "_bk"], "left")
    return r.select(F.col("_src").alias("_id"), F.coalesce("_hit", "_after").alias("_nxt"))


def _materialize(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint to the shared folder: one job computes and writes the level,
    later rounds read the files (lineage cut; a lost executor re-reads, never recomputes)."""
    return df.checkpoint(eager=True)


def greedy_ttl_accept(df: DataFrame, keys: Sequence[str], ts: str, id_col: str, ttl_us: int,
                      out: str = "accepted") -> DataFrame:
    """Greedy TTL de-duplication, exact and distributed.

    Per key, the first event is accepted and opens a window of ``ttl``; events with
    ``ts - accepted_ts <= ttl`` are duplicates (they do not extend it); the first event
    after it is accepted and opens a new window. The accepted events of a key are the
    orbit of its first event under ``next(e) = first event with ts > e.ts + ttl``.
    ``next`` comes from a bucketed as-of scan; the orbit is marked by pointer doubling,
    so no key is ever handled by one task, and the scan has a task for every ``ASOF_ROWS`` events. The number of rounds is ``log2`` of the
    longest possible orbit (``min(events, span / ttl + 1)`` per key, one aggregate); each
    jump table is checkpointed to the shared checkpoint folder, which keeps the plan
    linear and lets a lost executor resume from the last level. ``id_col`` must be a
    unique BIGINT.
    """
    from vigil.session import checkpoint_dir

    keys = list(keys)
    checkpoint_dir(df.sparkSession)
    ev = df.select(composite_key(keys).alias("_k"), F.col(ts).alias("_t"), F.col(id_col).alias("_id"))
    span = ev.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), (F.max("_t") - F.min("_t")).alias("_s"),
                                F.min_by("_id", F.struct("_t", "_id")).alias("_first"))
    long = span.filter(F.col("_s") > ttl_us)
    orbit = F.least("_n", F.floor(F.col("_s") / F.lit(ttl_us)) + 1)
    bound = span.agg(F.max(F.when(F.col("_s") > ttl_us, orbit)).alias("m"), F.sum("_n").alias("rows")).first()
    longest = int(bound["m"] or 0) if bound else 0
    rounds = max(0, math.ceil(math.log2(longest)) - 1) + 1 if longest > 1 else 0
    jumps: list[DataFrame] = []
    if rounds:
        parts = math.ceil(bound["rows"] / ASOF_ROWS)
        parts = parts if parts > int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
        ev = ev.repartition(parts, "_k") if parts else ev
        ev = ev.join(long.select("_k"), "_k", "left_semi")
        j = _materialize(_asof_next(ev, ttl_us, parts).filter(F.col("_nxt").isNotNull()))
        jumps.append(j)
        for _ in range(rounds - 1):
            a, b = j.alias("a"), j.alias("b")
            j = _materialize(a.join(b, F.col("a._nxt") == F.col("b._id"))
                             .select(F.col("a._id").alias("_id"), F.col("b._nxt").alias("_nxt")))
            jumps.append(j)
    acc = span.select(F.col("_first").alias("_id"))
    for j in reversed(jumps):
        acc = acc.unionByName(acc.join(j, "_id").select(F.col("_nxt").alias("_id")))
    acc = acc.distinct().select(F.col("_id").alias("_acc_id"), F.lit(True).alias("_acc"))
    res = df.join(acc, df[id_col] == acc["_acc_id"], "left")
    return res.withColumn(out, F.coalesce(F.col("_acc"), F.lit(False))).drop("_acc_id", "_acc")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float], width: int = 1_000_000) -> DataFrame:
    """Per group: ``n``, ``mean``, ``max`` and the exact percentiles ``ps`` (name -> p) of a BIGINT
    column, interpolated linearly between neighbours.

    Values are counted first; ranks are running totals inside stretches of ``width`` plus the
    totals of the stretches before, so no task holds all values of a group.
    """
    keys = list(keys)
    d = df if keys else df.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    c = d.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_s", F.floor(F.col("_v") / F.lit(width)))
    s = c.groupBy(*by, "_s").agg(F.sum("_c").alias("_t"))
    order = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(*by, "_s", F.coalesce(F.sum("_t").over(order), F.lit(0)).alias("_b"), F.sum("_t").over(Window.partitionBy(*by)).alias("_n"))
    run = Window.partitionBy(*by, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    x = c.withColumn("_r", F.sum("_c").over(run)).join(s, [*by, "_s"]).withColumn("_hi", F.col("_b") + F.col("_r"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_hi") - F.col("_c") <= rank) & (rank < F.col("_hi")), F.col("_v")))

    out = []
    for name, p in ps.items():
        place = (F.col("_n") - 1) * F.lit(p)
        low, high = F.floor(place), F.ceil(place)
        out.append((at(low) + (at(high) - at(low)) * F.max(place - low)).alias(name))
    n = F.sum("_c")
    g = x.groupBy(*by).agg(n.alias("n"), (F.sum(F.col("_c") * F.col("_v")) / n).alias("mean"), F.max("_v").alias("max"), *out)
    return g if keys else g.drop("_all")
