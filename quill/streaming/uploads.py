"""Uploads, continuations and pending hand-offs over a stream of events, with keyed state, timers and event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class UploadProcessor(StatefulProcessor):
    """The state of one token: when it was last used, whether a continuation is armed, and the page that waits. It goes by a timer once idle_seconds have passed since its last use."""

    def __init__(self, idle_seconds: float):
        self.idle_seconds = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("upload", "used double, armed boolean, page long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        used, armed, page = self.state.get() if self.state.exists() else (None, False, None)
        events = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        accepted = []
        for at, action, asked in zip(events["at"], events["action"], events["page"]):
            asked = None if pd.isna(asked) else int(asked)
            if action == "upload":
                used, armed, page = at, False, None
                accepted.append(True)
                continue
            if used is None or at - used > self.idle_seconds:
                used, armed, page = None, False, None
                accepted.append(False)
                continue
            used, ok = at, True
            if action in ("arm", "done"):
                armed = action == "arm"
            elif action == "append":
                ok = armed
            elif action == "wait":
                page = asked
            elif action == "submit":
                ok = page is not None and page == asked
                page = None if ok else page
            accepted.append(ok)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if used is None:
            self.state.clear()
        else:
            self.state.update((float(used), bool(armed), page))
            self.handle.registerTimer(int((used + self.idle_seconds) * 1000) + 1)
        yield pd.DataFrame({"token": key[0], "at": events["at"], "seq": events["seq"], "action": events["action"], "accepted": accepted})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"token": [], "at": [], "seq": [], "action": [], "accepted": []}).astype({"token": str, "at": float, "seq": "int64", "action": str, "accepted": bool})

    def close(self) -> None:
        pass


def upload_stream(events: DataFrame, idle_seconds: float = 1200, late: str = "10 seconds") -> DataFrame:
    """(token, at in seconds, seq, action, page) -> token, at, seq, action, accepted, as operators.state.upload_decisions decides for events that come in order. Time is the events' own, events older than the watermark (`late` behind the newest) are dropped; a token's state goes when the watermark passes its last use by more than idle_seconds. The session's state store must be RocksDB's."""
    timed = events.withColumn("time", F.timestamp_seconds("at")).withWatermark("time", late)
    return timed.groupBy("token").transformWithStateInPandas(UploadProcessor(idle_seconds), "token string, at double, seq long, action string, accepted boolean", "append", "eventTime")
