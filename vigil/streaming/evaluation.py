"""Rules on a stream: instant lookups by timers, ``for`` states with resolved edges, silent alerts.

Event-time timers of these processors emit rows: a tick is looked up once the watermark shows
that no older sample can come, a run of a rule ends when the next tick brought nothing, and a firing
alert is resolved when nothing was heard of it in time. What a key keeps is bounded by the
watermark's delay: samples are reduced to the newest of each tick, events to the first and last of
each stretch of the timeout.

A stream only knows the time from its rows. A source that may fall silent needs heartbeats: rows
that no rule names, which move the watermark on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.functions.timeutil import dur_us
from vigil.operators.rules import EVAL_INTERVAL, _cmp, _matches
from vigil.streaming.jobs import WATERMARK, _timed

LABELS = "map<string,string>"


class _Timed(StatefulProcessor):
    """A processor with one timer, due when the watermark has passed a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake_after(self, t_us: int | None) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if t_us is not None:
            self.handle.registerTimer(t_us // 1000 + 1)

    @staticmethod
    def passed(timer_values) -> int:
        """The latest time (us) that no later row can have."""
        return timer_values.getCurrentWatermarkInMs() * 1000 - 1

    def close(self) -> None:
        pass


TICK_OUT = T.StructType([*(T.StructField(c, T.StringType()) for c in ("metric", "instance", "series", "labels")), T.StructField("eval_us", T.LongType()),
                         T.StructField("value", T.DoubleType()), T.StructField("sample_us", T.LongType())])


class TickProcessor(_Timed):
    """Per series: the newest sample before each tick that is still to come. A timer looks up all ticks that the watermark has passed."""

    def __init__(self, start_us: int, step_us: int, lookback_us: int):
        self.start, self.step, self.lookback = start_us, step_us, lookback_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getListState("newest", "tick long, t_us long, value double")
        self.due = handle.getValueState("due", "eval_us long")

    def _keep(self, kept: dict, due: int) -> None:
        """Store what ticks from ``due`` on may see, and wake for the first of them."""
        old = [k for k in kept if k < due]
        for k in sorted(old)[:-1]:
            del kept[k]
        if old and (last := max(old)) in kept and kept[last][0] + self.lookback < due:
            del kept[last]
        if not kept:
            self.newest.clear()
            self.due.clear()
            self.wake_after(None)
            return
        due = max(due, min(kept))
        self.newest.put([(k, *kept[k]) for k in sorted(kept)])
        self.due.update((due,))
        self.wake_after(due)

    def handleInputRows(self, key, rows, timerValues):
        kept = {k: (t, v) for k, t, v in self.newest.get()} if self.newest.exists() else {}
        due = self.due.get()[0] if self.due.exists() else self.start
        for c in rows:
            t, v = c["t_us"].to_numpy(np.int64), c["value"].to_numpy(float)
            tick = self.start + np.maximum(0, -((self.start - t) // self.step)) * self.step
            order = np.lexsort((t, tick))
            last = np.append(tick[order][1:] != tick[order][:-1], True)
            for i in order[last]:
                k = int(tick[i])
                if k not in kept or kept[k][0] <= t[i]:
                    kept[k] = (int(t[i]), float(v[i]))
        self._keep(kept, due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kept = {k: (t, v) for k, t, v in self.newest.get()}
        due, until = self.due.get()[0], self.passed(timerValues)
        ticks = np.arange(due, until + 1, self.step)
        from_tick = np.array(sorted(kept))
        # No sample is newer than the last one: ticks beyond its lookback see nothing.
        ticks = ticks[ticks <= kept[int(from_tick[-1])][0] + self.lookback]
        at = np.searchsorted(from_tick, ticks, side="right") - 1
        t, v = (np.array(x) for x in zip(*(kept[int(k)] for k in from_tick)))
        seen = (at >= 0) & (t[at] + self.lookback >= ticks)
        done = due + max(0, (until - due) // self.step + 1) * self.step
        self._keep(kept, done)
        n = int(seen.sum())
        yield pd.DataFrame({**{c: [x] * n for c, x in zip(("metric", "instance", "series", "labels"), key)},
                            "eval_us": ticks[seen], "value": v[at[seen]], "sample_us": t[at[seen]]})


def tick_stream(samples: DataFrame, start_us: int, tick: str | int = EVAL_INTERVAL, lookback: str | int = "5m", delay: str = WATERMARK) -> DataFrame:
    """The instant lookup of every series at every tick from ``start`` on, as the watermark passes it."""
    s = samples.select("metric", "instance", "series", F.to_json("labels").alias("labels"), "t_us", "value")
    s = s.filter(F.col("t_us") >= F.lit(start_us - dur_us(lookback)))
    return _timed(s, "t_us", delay).groupBy("metric", "instance", "series", "labels").transformWithStateInPandas(
        TickProcessor(start_us, dur_us(tick), dur_us(lookback)), TICK_OUT, "Append", "EventTime")


STATE_OUT = T.StructType([
    T.StructField("rule_id", T.LongType()), T.StructField("series", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("eval_us", T.LongType()),
    T.StructField("active_since", T.LongType()), T.StructField("state", T.StringType()), T.StructField("edge", T.StringType()), T.StructField("value", T.DoubleType())])


class RuleStateProcessor(_Timed):
    """Per (rule, series): the run of true ticks. A false or missing tick ends it; if it fired, that gives a row ``resolved``."""

    def __init__(self, tick_us: int):
        self.tick = tick_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", "since long, last long, fired boolean, value double")

    def _ended(self, key, run: tuple) -> list[tuple]:
        since, last, fired, value = run
        return [(int(key[0]), key[1], key[2], last + self.tick, since, "resolved", "resolved", value)] if fired else []

    def handleInputRows(self, key, rows, timerValues):
        run, out = (self.run.get() if self.run.exists() else None), []
        all_rows = pd.concat([c[["eval_us", "is_true", "value", "for_ms"]] for c in rows]).sort_values("eval_us")
        for t, true, value, for_ms in all_rows.itertuples(index=False, name=None):
            t = int(t)
            if run is not None and (not true or t != run[1] + self.tick):
                out += self._ended(key, run)
                run = None
            if true:
                since = t if run is None else run[0]
                fires = t - since >= for_ms * 1000
                out.append((int(key[0]), key[1], key[2], t, since, "firing" if fires else "pending",
                            "firing" if fires and not (run is not None and run[2]) else None, float(value)))
                run = (since, t, bool(fires), float(value))
        if run is None:
            self.run.clear()
            self.wake_after(None)
        else:
            self.run.update(run)
            self.wake_after(run[1] + self.tick)
        yield pd.DataFrame(out, columns=STATE_OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.run.exists():
            yield pd.DataFrame(self._ended(key, self.run.get()), columns=STATE_OUT.names)
            self.run.clear()


def rule_state_stream(ticks: DataFrame, rules: DataFrame, end_us: int | None = None, tick: str | int = EVAL_INTERVAL, delay: str = WATERMARK) -> DataFrame:
    """``for`` states and edges from the lookups of ``tick_stream``; a resolved row has the first tick after its run.

    Rules are those on instant values (no ``fn``, no ``agg``); others are refused by an error at run time.
    """
    other = F.raise_error(F.lit("rule_state_stream: a rule that needs more than the newest sample")).cast("string")
    plain = (F.coalesce("fn", F.lit("none")) == "none") & (F.coalesce("agg", F.lit("none")) == "none")
    r = rules.filter(F.coalesce("enabled", F.lit(True))).select(
        F.col("id").alias("rule_id"), F.when(plain, F.col("metric")).otherwise(other).alias("_metric"),
        F.coalesce("matchers", F.create_map().cast(LABELS)).alias("_matchers"), F.col("cmp").alias("_cmp"), F.col("threshold").alias("_threshold"), "for_ms")
    t = _timed(ticks, "eval_us", delay)
    if end_us is not None:  # on the event time itself, so that rows after the end still move the watermark
        t = t.filter(F.col("ts") <= F.timestamp_micros(F.lit(end_us)))
    t = t.join(r, F.col("metric") == F.col("_metric")).filter(_matches(F.from_json("labels", LABELS), F.col("_matchers")))
    t = t.select("rule_id", "series", "labels", "eval_us", "value", _cmp(F.col("value"), F.col("_cmp"), F.col("_threshold")).alias("is_true"), "for_ms", "ts")
    return t.groupBy("rule_id", "series", "labels").transformWithStateInPandas(RuleStateProcessor(dur_us(tick)), STATE_OUT, "Append", "EventTime")


SILENT_OUT = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("status", T.StringType()),
                           T.StructField("labels", T.StringType()), T.StructField("annotations", T.StringType()), T.StructField("starts_us", T.LongType()),
                           T.StructField("ends_us", T.LongType()), T.StructField("received_us", T.LongType())])


class SilentProcessor(_Timed):
    """Per fingerprint: events not yet passed by the watermark, as first and last of each stretch of ``timeout``, and the last one before them.

    Inside a stretch no two events are further apart than the timeout, so nothing between them matters.
    """

    _EVENT = "stretch long, first_us long, received_us long, event_id long, firing boolean, starts_us long, labels string, annotations string"

    def __init__(self, timeout_us: int):
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.events = handle.getListState("events", self._EVENT)

    def _store(self, events: list[tuple]) -> None:
        if events:
            self.events.put(events)
            self.wake_after(events[0][2] + self.timeout)
        else:
            self.events.clear()
            self.wake_after(None)

    def handleInputRows(self, key, rows, timerValues):
        held = {e[0]: e for e in self.events.get()} if self.events.exists() else {}
        for c in rows:
            for e in c.sort_values(["received_us", "event_id"]).itertuples(index=False):
                k = int(e.received_us) // self.timeout
                now = (k, int(e.received_us), int(e.received_us), int(e.event_id), e.status == "firing", None if pd.isna(e.starts_us) else int(e.starts_us), e.labels, e.annotations)
                old = held.get(k)
                if old is None:
                    held[k] = now
                elif (now[2], now[3]) >= (old[2], old[3]):
                    held[k] = (k, min(old[1], now[1]), *now[2:])
                else:
                    held[k] = (k, min(old[1], now[1]), *old[2:])
        self._store([held[k] for k in sorted(held)])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        events, until, out = list(self.events.get()), self.passed(timerValues), []
        while events:
            e = events[0]
            end = e[2] + self.timeout
            following = events[1][1] if len(events) > 1 else None
            if following is not None and following <= end:
                if following > until:  # an event before it may still come
                    break
            elif end > until:
                break
            elif e[4]:
                out.append((key[0], e[3], "resolved", e[6], e[7], e[5], end, end))
            events.pop(0)
        self._store(events)
        yield pd.DataFrame(out, columns=SILENT_OUT.names)


def resolve_timeout_stream(events: DataFrame, timeout: str | int = "5m", delay: str = WATERMARK) -> DataFrame:
    """Synthetic ``resolved`` events of firing alerts that nothing was heard of for ``timeout``, emitted by timers."""
    e = events.select("fingerprint", "event_id", "status", F.to_json("labels").alias("labels"), F.to_json("annotations").alias("annotations"), "starts_us", "received_us")
    out = _timed(e, "received_us", delay).groupBy("fingerprint").transformWithStateInPandas(SilentProcessor(dur_us(timeout)), SILENT_OUT, "Append", "EventTime")
    return out.withColumns({c: F.from_json(c, LABELS) for c in ("labels", "annotations")})
