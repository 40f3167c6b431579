"""The sliding-window limiter as keyed streaming state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as fx
from ..operators.rate import accept_sorted

_OUT = "request_id string, key string, t bigint, allowed boolean"


class Limiter(StatefulProcessor):
    """Accepted times of the last window as a list state, and a timer that empties it."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "t bigint")

    def _keep(self, times: list[int], held: bool) -> None:
        """Stores the times; the timer fires when the watermark has passed the last one by a window.

        Every call here is a message to the JVM. A key has a timer only while its times are ``held``.
        """
        for at in list(self.handle.listTimers()) if held else ():
            self.handle.deleteTimer(at)
        if times:
            self.accepted.put([(t,) for t in times])
            self.handle.registerTimer(-(-(times[-1] + self.window_us) // 1000))
        elif held:
            self.accepted.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch may reach a key in several frames; decisions need them in time order.
        frame = pd.concat(list(rows)).sort_values(["t", "request_id"], kind="stable")
        times = frame["t"].to_numpy(dtype=np.int64)
        recent = deque(t for (t,) in self.accepted.get())
        held = len(recent) > 0
        mask = accept_sorted(times, recent, self.limit, self.window_us)
        newest = int(times[-1])
        self._keep([t for t in recent if newest - t < self.window_us], held)
        yield pd.DataFrame({"request_id": frame["request_id"].to_numpy(), "key": key[0], "t": times, "allowed": mask})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, max_requests: int = fx.RATE_LIMIT_REQUESTS,
                      window_seconds: int = fx.RATE_LIMIT_WINDOW_SECONDS, late: str = "1 minute") -> DataFrame:
    """Streaming (request_id, key, t, allowed) for rows (request_id, key, t in microseconds).

    The state of a key is the times of its last accepted requests, at most ``max_requests``; it is gone once
    the watermark, ``late`` behind the newest request, is a window past the last of them. No row is dropped:
    those that come late, in a later micro-batch, are decided on arrival, by the state that is left.
    """
    timed = requests.select("request_id", "key", "t", F.timestamp_micros("t").alias("at")).withWatermark("at", late)
    # The watermark drives the timers; without its column no row is dropped for being behind it.
    return timed.select("request_id", "key", "t").groupBy("key").transformWithStateInPandas(
        Limiter(max_requests, window_seconds * 1_000_000), _OUT, "append", "EventTime")
