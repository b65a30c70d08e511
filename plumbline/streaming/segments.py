"""The event state machine over a stream, and counts by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import State, follow

OUT = "file string, start long, end long, label int, cue long, end_code int, error string"
STATE = "phase string, label int, cue long, start long"


def stream_segments(events: DataFrame) -> DataFrame:
    """Segments of a stream (file string, sample long, code int), in the order of each file's samples within a batch.

    The state of a file is its open cue or task: four values. An event out of order gives a row with `error` and resets the
    file's state, where the batch function would raise.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = State(*state.get) if state.exists else State()
        out = []
        rows = pd.concat(list(batches)).sort_values("sample", kind="stable")
        for sample, code in zip(rows["sample"].tolist(), rows["code"].tolist(), strict=True):
            now, found = follow(now, sample, code)
            if found:
                out.append((key[0], *found))
        state.update(tuple(now))
        columns = [c.split()[0] for c in OUT.split(", ")]
        yield pd.DataFrame(out, columns=columns).astype({"start": "Int64", "end": "Int64", "label": "Int32", "cue": "Int64", "end_code": "Int32"})

    return events.select("file", "sample", "code").groupBy("file").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, late: str, size: str, by: list[str]) -> DataFrame:
    """Counts by event-time window, with a watermark for late rows."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"))
