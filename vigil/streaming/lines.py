"""CRI log lines on a stream: partial pieces of a file are kept until the line that closes them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from vigil.functions.timeutil import dur_us
from vigil.streaming.evaluation import _Timed
from vigil.streaming.jobs import WATERMARK, _timed

LINE_OUT = T.StructType([T.StructField("file", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("stream", T.StringType()),
                         T.StructField("time_us", T.LongType()), T.StructField("text", T.StringType()), T.StructField("closed", T.BooleanType())])


class LineProcessor(_Timed):
    """Per file: the pieces (tag P) since the last full line (tag F). Lines of a file come in order of their numbers.

    Pieces that nothing closed within ``timeout`` of the last one are given out as they are, not closed.
    """

    def __init__(self, timeout_us: int):
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "text string, line_no long, stream string, time_us long")

    def handleInputRows(self, key, rows, timerValues):
        text, last, out = [], None, []
        if self.open.exists():
            text, *last = (lambda r: [[r[0]], *r[1:]])(self.open.get())
        lines = pd.concat(list(rows)).sort_values("line_no")
        for no, tag, stream, time_us, log in zip(*(lines[c].tolist() for c in ("line_no", "tag", "stream", "time_us", "log"))):
            text.append(log)
            last = (int(no), stream, None if time_us is None or np.isnan(time_us) else int(time_us))
            if tag == "F":
                out.append((key[0], last[0], last[1], last[2], "".join(text), True))
                text, last = [], None
        if text:
            self.open.update(("".join(text), *last))
            self.wake_after((last[2] or 0) + self.timeout)
        else:
            self.open.clear()
            self.wake_after(None)
        yield pd.DataFrame(out, columns=LINE_OUT.names).astype({"time_us": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.open.exists():
            text, no, stream, time_us = self.open.get()
            self.open.clear()
            yield pd.DataFrame([(key[0], no, stream, time_us, text, False)], columns=LINE_OUT.names).astype({"time_us": "Int64"})


def assembled_lines(lines: DataFrame, timeout: str | int = "5m", delay: str = WATERMARK) -> DataFrame:
    """``LINE_OUT`` from ``file, line_no, tag, stream, time_us, log`` rows of a stream."""
    rows = lines.select("file", "line_no", "tag", "stream", "time_us", "log")
    return _timed(rows, "time_us", delay).groupBy("file").transformWithStateInPandas(LineProcessor(dur_us(timeout)), LINE_OUT, "Append", "EventTime")
