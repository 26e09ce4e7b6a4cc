"""Sliding-window rate limits: a call is denied while `most` allowed ones lie within the window before it.

Denied calls do not count, so each decision rests on those before: no window frame says that. Calls of a
key are decided in order, in one group in batch, by keyed state in a stream. The state of a key is at
most `most` times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.shipping import ship


def decide(times: Iterable[float], most: int, window: float, held: Iterable[float] = ()) -> tuple[list[bool], list[float]]:
    """(allowed or not for each time in order, allowed times still in the window). A limit of 0 allows all."""
    if most <= 0:
        return [True for _ in times], []
    recent, out = deque(held), []
    for t in times:
        while recent and recent[0] <= t - window:
            recent.popleft()
        out.append(len(recent) < most)
        if out[-1]:
            recent.append(t)
    return out, list(recent)


def limit(calls: DataFrame, most: int, window: float, *, key: str = "key", time: str = "now", order: str = "call_id") -> DataFrame:
    """(order, key, time, allowed) of a batch of calls; time in seconds."""
    ship(calls.sparkSession)
    own = calls.select(F.col(order).alias("call_id"), F.col(key).cast("string").alias("key"), F.col(time).cast("double").alias("now"))
    kind = dict(own.dtypes)["call_id"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["now", "call_id"], kind="stable")
        return frame.assign(allowed=decide(frame["now"], most, window)[0])

    return own.groupBy("key").applyInPandas(run, f"call_id {kind}, key string, now double, allowed boolean")


def limit_stream(calls: DataFrame, most: int, window: float) -> DataFrame:
    """The same for a stream of (call_id long, key string, now double); calls of a micro-batch are taken in the order of time."""
    ship(calls.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["now", "call_id"], kind="stable")
        allowed, held = decide(frame["now"], most, window, state.get[0] if state.exists else ())
        state.update((held,))
        yield frame.assign(allowed=allowed)[["call_id", "key", "now", "allowed"]]

    return calls.groupBy("key").applyInPandasWithState(run, "call_id long, key string, now double, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)
