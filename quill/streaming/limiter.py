"""The sliding-window limiter over a stream of requests, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limit_stream(requests: DataFrame, most: int, window_seconds: float, drop_idle: bool = True) -> DataFrame:
    """(key, at in seconds) -> key, at, allowed, as operators.state.limit_requests decides. A micro-batch's requests are sorted by key before they are judged; a request older than the newest judged one of its key is judged at that one's time. With drop_idle, keys idle for a window by the clock drop their state; such a query runs batches for timeouts without end, so one over finite input sets it to False."""

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        newest = state.get[1] if state.exists else float("-inf")
        times, allowed = sorted(t for p in parts for t in p["at"]), []
        for t in times:
            newest = max(newest, t)
            live = [x for x in live if x > newest - window_seconds]
            allowed.append(len(live) < most)
            if allowed[-1]:
                live.append(newest)
        state.update((live, newest))
        if drop_idle:
            state.setTimeoutDuration(max(1, int(window_seconds * 1000)))
        yield pd.DataFrame({"key": [key[0]] * len(times), "at": times, "allowed": allowed})

    return requests.groupBy("key").applyInPandasWithState(judge, "key string, at double, allowed boolean", "live array<double>, newest double", "append", GroupStateTimeout.ProcessingTimeTimeout if drop_idle else GroupStateTimeout.NoTimeout)
