"""Per-frame state over streams. How late rows are treated is our own choice: a watermark, and rows behind it are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_states(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """window start, event_type, n, mean: tumbling hours of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def _moves(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    for pdf in parts:
        out = []
        for frame, x, y in pdf.sort_values("frame")[["frame", "x", "y"]].itertuples(index=False):
            if last is None or frame > last[0]:
                if last is not None:
                    out.append((key[0], frame, float(((x - last[1]) ** 2 + (y - last[2]) ** 2) ** 0.5 / (frame - last[0]))))
                last = (int(frame), float(x), float(y))
        yield pd.DataFrame(out, columns=["individual", "frame", "speed"])
    if last is not None:
        state.update(last)


def speeds(positions: DataFrame) -> DataFrame:
    """individual, frame, speed: from each individual's last position, which is all the state there is. Rows of frames already passed are dropped."""
    return positions.groupBy("individual").applyInPandasWithState(_moves, "individual long, frame long, speed double", "frame long, x double, y double", "append", GroupStateTimeout.NoTimeout)
