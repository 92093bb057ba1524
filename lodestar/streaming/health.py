"""Streaming forms of the tick operators: an addition, since batch is all that the survey lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_means(ticks: DataFrame, time: str, value: str, size: str, delay: str) -> DataFrame:
    """Mean per tumbling window, with late rows dropped after ``delay``; works on batch and streaming frames."""
    return ticks.withWatermark(time, delay).groupBy(F.window(time, size)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def first_spans(spans: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Spans without repeats of a key within the watermark."""
    return spans.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def transitions(ticks: DataFrame, key: str, time: str, state: str, delay: str) -> DataFrame:
    """(key, t, direction): changes of an entity's state as a stream, in the order of event time.

    A tick is held until the watermark has passed it, so ticks that come out of order within ``delay`` count as if they
    had come in order, and the result is that of the batch operator; later ones are dropped. The state of an entity is
    its last tick and those that wait; a timer at the first of them closes it when nothing more comes. t is in microseconds.
    """
    kind = dict(ticks.dtypes)[key]

    def step(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known, last, waiting_t, waiting_s = held.get if held.exists else (False, None, [], [])
        waiting = list(zip(waiting_t, waiting_s))
        for frame in frames:
            states = frame[state].astype(object).where(frame[state].notna(), None)
            waiting += [(int(t), None if s is None else bool(s)) for t, s in zip(frame["_us"], states)]
        passed, out = held.getCurrentWatermarkMs(), []
        waiting.sort(key=lambda w: w[0])
        ready = [w for w in waiting if w[0] <= passed * 1000]
        for t, s in ready:
            if known and s is not last:
                out.append((*name, t, "degradation" if last and s is False else "recovery" if last is False and s else "other"))
            known, last = True, s
        waiting = waiting[len(ready):]
        held.update((known, last, [t for t, _ in waiting], [s for _, s in waiting]))
        if waiting:
            held.setTimeoutTimestamp(max(waiting[0][0] // 1000, passed + 1))
        yield pd.DataFrame(out, columns=[key, "t", "direction"])

    marked = ticks.withWatermark(time, delay).select(key, time, state, F.unix_micros(time).alias("_us"))
    return marked.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, t long, direction string", "known boolean, last boolean, t array<long>, s array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
