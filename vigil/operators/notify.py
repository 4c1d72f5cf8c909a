"""Notification flushes of alert groups: the timer walk of a group as composable maps of time stretches.

A group's timer starts ``wait`` after its first event, then ticks every ``interval`` from there. A
tick sends if the group changed since the last one, or if it still fires and ``repeat`` has
passed; resolved members leave after they were sent, and a group without members ends. The next
event after that starts a new life with a timer of its own.

Only the lives depend on what came before, and on very little of it: on the place of the timer's
ticks. How many members fire at a time, F, is a running sum; a life ends at its first tick at
which F is 0. So the rows of a group are cut into stretches of time, and each stretch is a map

    place of the first tick in the stretch  ->  place of the first tick after it (or no life)

which is constant on few intervals of places: those whose ticks first meet the same moment with F
= 0, and the rest, which passes through. The maps are small; walking them in order, one number at
a time, gives each stretch its place at entry, and with it the stretches are independent again.
Everything else (which events a tick sends, repeats) is grouping by tick.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.timeutil import dur_us
from vigil.operators.routing import GROUP_BY
from vigil.operators.scans import DEFAULT_BUCKET_US, _materialize, keyed_lag, keyed_running_sum
from vigil.session import checkpoint_dir

GROUP_WAIT = "10s"
GROUP_INTERVAL = "30s"
REPEAT_INTERVAL = "4h"
IDLE = -1


class Stretch:
    """The moments of one stretch: distinct event times, how many members fire from each on, and the time of the next stretch's first event."""

    def __init__(self, times: np.ndarray, firing: np.ndarray, following: int | None, wait: int, interval: int):
        last = np.append(times[1:] != times[:-1], True)  # several events at one time: the last one's count
        self.at, self.firing = times[last], firing[last]
        self.to = np.append(self.at[1:], np.iinfo(np.int64).max if following is None else following)
        self.quiet = np.flatnonzero(self.firing == 0)
        self.wait, self.interval, self.exits = wait, interval, {}

    def ended_in(self, tick: int) -> int | None:
        """The first quiet moment that a tick from ``tick`` on meets, as index into ``at``."""
        k, step = int(np.searchsorted(self.to[self.quiet], tick, side="right")), 64
        while k < len(self.quiet):
            j = self.quiet[k:k + step]
            first = tick + np.maximum(0, -((tick - self.at[j]) // self.interval)) * self.interval
            hit = np.flatnonzero(first < self.to[j])
            if len(hit):
                return int(j[hit[0]])
            k, step = k + step, 2 * step
        return None

    def passed(self, tick: int) -> int:
        """The first tick after the stretch; the last stretch has none."""
        if self.to[-1] == np.iinfo(np.int64).max:
            return IDLE
        return tick + max(0, -((tick - int(self.to[-1])) // self.interval)) * self.interval

    def exit(self, tick: int) -> int:
        """First tick after the stretch of the life that is then on, ``IDLE`` if none; ``tick`` is the first one in it."""
        seen = []
        while True:
            j = self.ended_in(tick)
            if j is None:
                out = self.passed(tick)
            elif j == len(self.at) - 1:
                out = IDLE
            elif j in self.exits:
                out = self.exits[j]
            else:
                seen.append(j)
                tick = int(self.to[j]) + self.wait
                continue
            self.exits.update(dict.fromkeys(seen, out))
            return out

    def map(self) -> tuple[list[int], list[int], list[int]]:
        """``(low, high, exit)``: first ticks in ``[low, high)`` leave the stretch at ``exit``; all others pass through."""
        base, found = int(self.at[0]), []
        left = [(base, base + max(self.wait, self.interval) + 1)]
        for j in self.quiet.tolist():
            if not left:
                break
            a, b = int(self.at[j]), int(self.to[j])
            out = IDLE if j == len(self.at) - 1 else self.exit(b + self.wait)
            rest = []
            for low, high in left:
                # Ticks of this place meet [a, b) after k intervals, the smallest k first.
                k = max(0, -((high - 1 - a) // self.interval))
                while low < high and a - k * self.interval + (b - a) > low:
                    x, y = max(low, a - k * self.interval), min(high, b - k * self.interval)
                    if x < y:
                        found.append((x, y, out))
                        if y < high:
                            rest.append((y, high))
                        high = x
                    k += 1
                if low < high:
                    rest.append((low, high))
            left = rest
        merged = []
        for low, high, out in sorted(found):
            if merged and merged[-1][1] == low and merged[-1][2] == out:
                merged[-1] = (merged[-1][0], high, out)
            else:
                merged.append((low, high, out))
        return tuple(map(list, zip(*merged))) if merged else ([], [], [])

    def lives(self, entry: int | None) -> tuple[np.ndarray, np.ndarray]:
        """``(from, first)``: a life with first tick ``first`` holds the events from ``from`` on; ``entry`` is its first tick here, None if none is on."""
        starts, firsts = [int(self.at[0])], [int(self.at[0]) + self.wait if entry is None else entry]
        while (j := self.ended_in(firsts[-1])) is not None and j < len(self.at) - 1:
            starts.append(int(self.to[j]))
            firsts.append(int(self.to[j]) + self.wait)
        return np.array(starts), np.array(firsts)


def _walk(keys: int, interval: int):
    """Entry of every stretch, walking the maps of a group in order: one number is carried."""

    def run(batches):
        group, state = None, IDLE
        for b in batches:
            entries = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key, (base, following, idle, low, high, out) = row[:keys], row[keys + 1:]
                if key != group:
                    group, state = key, IDLE
                entries.append(None if state == IDLE else state)
                if state == IDLE:
                    state = idle
                elif (k := int(np.searchsorted(low, state, side="right")) - 1) >= 0 and state < high[k]:
                    state = out[k]
                elif following is not None:
                    state += max(0, -((state - following) // interval)) * interval
            yield pa.RecordBatch.from_arrays([*b.columns[:keys + 1], pa.array(entries, pa.int64())], names=[*b.schema.names[:keys + 1], "_entry"])

    return run


def alert_notify(E: DataFrame, now_us: int, wait: str = GROUP_WAIT, interval: str = GROUP_INTERVAL, repeat: str = REPEAT_INTERVAL,
                 by: Sequence[str] = GROUP_BY, bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Notification flushes per group until ``now``: ``by``, flush_us, n_alerts, n_firing, reason.

    First ``wait`` after the group's first event (``initial``), then on the ``interval`` grid when the group
    changed (``change``), else every ``repeat`` while it still fires (``repeat``).

    A group is dealt by stretches of ``bucket_us``; the walk over their maps holds one number per group.
    Members of a group and of a tick are counted, never gathered. Status changes and flushes are stored (reliable checkpoints).
    """
    by, wait_us, every = list(by), dur_us(wait), dur_us(interval)
    e = E.select(*(F.coalesce(F.element_at("labels", F.lit(k)), F.lit("")).alias(k) for k in by), "fingerprint", "status", "received_us", "event_id")
    e = keyed_lag(e, ["fingerprint"], "received_us", "event_id", ["status"], bucket_us)
    # Only changes of a member's status matter; the first event of a member is one.
    e = e.filter(F.col("prev_status").isNull() | (F.col("prev_status") != F.col("status")))
    e = e.withColumn("_step", F.when(F.col("status") == "firing", 1).when(F.col("prev_status") == "firing", -1).otherwise(0).cast("bigint"))
    e = keyed_running_sum(e, by, "received_us", "event_id", "_step", "_firing", bucket_us)
    e = e.select(*by, "fingerprint", "status", "received_us", "event_id", "_firing", F.floor(F.col("received_us") / F.lit(bucket_us)).cast("bigint").alias("_stretch"))

    checkpoint_dir(E.sparkSession)
    e = _materialize(e)  # read by the maps and again by the lives
    heads = e.groupBy(*by, "_stretch").agg((-F.min("received_us")).alias("_neg"))
    heads = keyed_lag(heads, by, "_neg", "_stretch", [], bucket_us * 1024).select(*by, "_stretch", (-F.col("prev__neg")).alias("_following"))
    e = e.join(heads, [*by, "_stretch"])
    names = ", ".join(f"`{c}` string" for c in by) + ", _stretch bigint"

    def stretch(pdf: pd.DataFrame) -> Stretch:
        following = pdf["_following"].iloc[0]
        return Stretch(pdf["received_us"].to_numpy(), pdf["_firing"].to_numpy(), None if pd.isna(following) else int(following), wait_us, every)

    def as_map(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = stretch(pdf.sort_values(["received_us", "event_id"]))
        low, high, out = s.map()
        following = pdf["_following"].iloc[0]
        row = (*key, int(s.at[0]), None if pd.isna(following) else int(following), s.exit(int(s.at[0]) + wait_us), low, high, out)
        return pd.DataFrame([row], columns=[*by, "_stretch", "_base", "_following", "_idle", "_low", "_high", "_exit"]).astype({"_following": "Int64"})

    moments = e.select(*by, "_stretch", "received_us", "event_id", "_firing", "_following")
    maps = moments.groupBy(*by, "_stretch").applyInPandas(
        as_map, names + ", _base bigint, _following bigint, _idle bigint, _low array<bigint>, _high array<bigint>, _exit array<bigint>")
    entries = maps.repartition(*by).sortWithinPartitions(*by, "_stretch").mapInArrow(_walk(len(by), every), names + ", _entry bigint")

    def with_first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["received_us", "event_id"])
        entry = pdf["_entry"].iloc[0]
        starts, firsts = stretch(pdf).lives(None if pd.isna(entry) else int(entry))
        first = firsts[np.searchsorted(starts, pdf["received_us"].to_numpy(), side="right") - 1]
        return pdf[[*by, "fingerprint", "status", "received_us", "event_id", "_firing"]].assign(_first=first)

    lived = e.join(entries, [*by, "_stretch"]).groupBy(*by, "_stretch").applyInPandas(
        with_first, ", ".join(f"`{c}` string" for c in by) + ", fingerprint string, status string, received_us bigint, event_id bigint, _firing bigint, _first bigint")
    return _flushes(lived, by, now_us, every, dur_us(repeat), bucket_us)


def _flushes(lived: DataFrame, by: list[str], now_us: int, every: int, repeat_us: int, bucket_us: int) -> DataFrame:
    """Flushes from events that know a tick (``_first``) of their life."""
    later = F.greatest(F.lit(0), F.ceil((F.col("received_us") - F.col("_first")) / F.lit(every)))
    tick = (F.col("_first") + later * F.lit(every)).cast("bigint")
    last = F.struct("received_us", "event_id")
    member = lived.withColumn("flush_us", tick).filter(F.col("flush_us") <= now_us).groupBy(*by, "flush_us", "fingerprint").agg(
        F.max_by("status", last).alias("status"), F.max(F.struct("received_us", "event_id", "_firing")).alias("_last"))
    flush = member.groupBy(*by, "flush_us").agg(F.sum((F.col("status") == "resolved").cast("bigint")).alias("_resolved"), F.max("_last").alias("_last"))
    flush = flush.select(*by, "flush_us", (F.col("_last._firing") + F.col("_resolved")).alias("n_alerts"), F.col("_last._firing").alias("n_firing"))
    flush = _materialize(flush)  # read four times below
    # A flush after which none fires ended the life before; the first of all has none before it.
    flush = keyed_lag(flush.withColumn("_tie", F.lit(0)), by, "flush_us", "_tie", ["n_firing"], bucket_us)
    flush = flush.withColumn("reason", F.when(F.coalesce("prev_n_firing", F.lit(0)) == 0, "initial").otherwise("change")).drop("prev_n_firing", "prev_flush_us")
    following = keyed_lag(flush.withColumn("_neg", -F.col("flush_us")), by, "_neg", "_tie", [], bucket_us)
    again = -(-repeat_us // every) * every
    until = F.least(F.coalesce(-F.col("prev__neg") - 1, F.lit(now_us)), F.lit(now_us))
    repeats = following.filter((F.col("n_firing") > 0) & (F.col("flush_us") + again <= until)).select(
        *by, F.explode(F.sequence(F.col("flush_us") + again, until, F.lit(again).cast("bigint"))).alias("flush_us"),
        F.col("n_firing").alias("n_alerts"), "n_firing", F.lit("repeat").alias("reason"))
    return flush.select(*by, "flush_us", "n_alerts", "n_firing", "reason").unionByName(repeats)
