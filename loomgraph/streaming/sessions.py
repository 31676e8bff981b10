"""Sessions in a stream: what `sessions` of plans/ranking.py gives a table, with state for each key that outlives batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86_400_000_000
#: last row's time, thread of the last row that lay apart, sessions so far; and the rows that wait for the watermark.
STATE = "last long, thread string, session long, ts array<long>, ids array<long>, threads array<string>"
OUT = "key long, event_id long, ts_us long, session long"


def _step(gap: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, thread, session, *held = state.get if state.exists else (None, None, 0, [], [], [])
        mark = state.getCurrentWatermarkMs() * 1000
        rows = list(zip(*map(list, held), strict=True))
        if not state.hasTimedOut:
            for pdf in batches:
                rows += zip(pdf["ts_us"].tolist(), pdf["event_id"].tolist(), pdf["thread"].where(pdf["thread"].notna(), None).tolist(), strict=True)
        rows.sort(key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= mark]
        wait = rows[len(ready) :]
        found = []
        for ts, event, of in ready:
            if last is None or ts // DAY != last // DAY or ts - last > gap:
                if thread is None or of != thread:
                    session += 1
                thread = of
            last = ts
            found.append((key[0], event, ts, session))
        state.update((last, thread, session, *([r[i] for r in wait] for i in range(3))))
        if wait:
            # As soon as the watermark is past the first that waits.
            state.setTimeoutTimestamp(max(wait[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(found, columns=[c.split()[0] for c in OUT.split(", ")])

    return step


def stream_sessions(stream: DataFrame, hours: int = 6, late: str = "1 day") -> DataFrame:
    """OUT of a stream (user_id, ts, event_id, thread): rows with their session, numbered from 1 for each key, in the order of (ts, event_id).

    A row is handed on once the watermark (`late` behind the latest time seen) has passed it, so rows may come in any order within
    that; later ones are left out.  What is kept of a key is its last row's time, one thread, a count, and the rows that wait.
    Null threads are in none; rows without user_id or ts are left out; times are whole microseconds in UTC."""
    rows = stream.where("user_id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select(F.col("user_id").cast("long").alias("user_id"), "ts", F.unix_micros("ts").alias("ts_us"), F.col("event_id").cast("long").alias("event_id"), "thread")
    return rows.groupBy("user_id").applyInPandasWithState(_step(hours * 3_600_000_000), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
