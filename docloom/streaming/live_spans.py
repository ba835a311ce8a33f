"""Spans while they run: signals of spans that open, exit or are dropped become one row a span, each told once.

Signals are (span_id, parent_id, ts, signal), signal one of SIGNALS, in any order and repeated. A span's state is its
earliest opening and its earliest end. It is told when the watermark has passed its end, so that no earlier signal can
come any more; a span without an end, or without an opening, is told ``patience`` after its last signal. State goes when
a span is told, so it is bounded by the spans that run or wait. What comes later than the watermark doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.session import ship_package

OPENS, EXITS, DROPS = SIGNALS = ("new", "exit", "drop")
SPANS = "span_id string, parent_id string, start timestamp, end timestamp, state string"
_STATE = "parent string, start long, end long, kind string, last long"


def spans(signals: DataFrame) -> DataFrame:
    """The same from a table that holds all signals: span_id, parent_id, start, end, state."""
    rows = signals.where(F.col("span_id").isNotNull() & F.col("ts").isNotNull() & F.col("signal").isin(*SIGNALS))
    opening = F.min(F.when(F.col("signal") == OPENS, F.struct("ts", "parent_id"))).alias("o")
    ending = F.min(F.when(F.col("signal") != OPENS, F.struct("ts", "signal"))).alias("e")
    told = rows.groupBy("span_id").agg(opening, ending)
    state = F.when(F.col("o").isNull(), "unopened").when(F.col("e").isNull(), "lost").when(F.col("e.signal") == EXITS, "exited").otherwise("dropped")
    return told.select("span_id", F.col("o.parent_id").alias("parent_id"), F.col("o.ts").alias("start"), F.col("e.ts").alias("end"), state.alias("state"))


def live_spans(signals: DataFrame, late: str = "10 minutes", patience_minutes: int = 60) -> DataFrame:
    """A stream of spans, as ``spans`` has them, from a stream of signals that come at most ``late`` out of order."""
    ship_package(signals.sparkSession)
    patience = patience_minutes * 60_000_000

    def told(span_id: str, parent: str | None, start: int | None, end: int | None, kind: str | None) -> pd.DataFrame:
        state = "unopened" if start is None else "lost" if end is None else "exited" if kind == EXITS else "dropped"
        at = lambda x: pd.Timestamp(x, unit="us") if x is not None else pd.NaT
        return pd.DataFrame({"span_id": [span_id], "parent_id": [parent], "start": pd.to_datetime([at(start)]), "end": pd.to_datetime([at(end)]), "state": [state]})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parent, start, end, kind, last = state.get if state.exists else (None, None, None, None, 0)
        if state.hasTimedOut:
            state.remove()
            yield told(key[0], parent, start, end, kind)
            return
        for batch in batches:
            for ts, signal, above in zip(batch["at"].tolist(), batch["signal"], batch["parent_id"]):
                above = above if isinstance(above, str) else None
                last = max(last, ts)
                if signal == OPENS:
                    if start is None or (ts, above is not None, above or "") < (start, parent is not None, parent or ""):
                        start, parent = ts, above
                elif end is None or (ts, signal) < (end, kind):
                    end, kind = ts, signal
        state.update((parent, start, end, kind, last))
        due = end if start is not None and end is not None else last + patience
        state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs()) + 1)

    rows = signals.where(F.col("span_id").isNotNull() & F.col("ts").isNotNull() & F.col("signal").isin(*SIGNALS))
    rows = rows.withWatermark("ts", late).select("span_id", "parent_id", "ts", "signal", F.unix_micros("ts").alias("at"))
    return rows.groupBy("span_id").applyInPandasWithState(step, SPANS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
