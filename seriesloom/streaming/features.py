"""Streaming forms of operators whose state is small and of fixed size.

Windowed features aggregate by event time with a watermark; walkers and moving thresholds are
recurrences that keep two numbers per series.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, series: str, ts: str, value: str, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """series_id, window start, count, mean, deviation, least and greatest value; rows later than ``late`` are dropped."""
    rows = stream.select(F.col(series).alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("v")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy("series_id", w.alias("w")).agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.select("series_id", F.col("w.start").alias("start"), "n", "mean", "sd", "low", "high")


def recurrences(stream: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """series_id, place, walker and threshold at each value, in the order of ``order`` within each micro-batch.

    Values are taken as given: a stream has no mean to standardize by. Null values are left out.
    """
    rows = stream.where(F.col(value).isNotNull()).select(F.col(series).alias("series_id"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.col(value).cast("double").alias("v"))
    places = [f"__o{i}" for i in range(len(order))]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, walker, last, threshold = state.get if state.exists else (0, 0.0, 0.0, 1.0)
        out = []
        for v in pd.concat(list(frames)).sort_values(places)["v"]:
            if place:
                walker += 0.1 * (last - walker)
            threshold = 1.1 * abs(v) if abs(v) > threshold else 0.9 * threshold
            out.append((key[0], place, walker, threshold))
            place, last = place + 1, v
        state.update((place, walker, last, threshold))
        yield pd.DataFrame(out, columns=["series_id", "place", "walker", "threshold"])

    kind = rows.schema["series_id"].dataType.simpleString()
    return rows.groupBy("series_id").applyInPandasWithState(step, f"series_id {kind}, place long, walker double, threshold double", "place long, walker double, last double, threshold double", "append", GroupStateTimeout.NoTimeout)
