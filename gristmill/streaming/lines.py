"""Streams of tool output and a cache with a time to live, on Structured Streaming.

The batch operators work on streams as they are; what needs state over time is here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.diagnostics import FIELDS, problem


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """New lines of the text files that appear in a folder."""
    return spark.readStream.text(path).withColumnRenamed("value", "line")


def problem_stream(lines: DataFrame, line: str = "line", ts: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Distinct diagnostics of a stream. With an event time, repeats are forgotten after the watermark's delay."""
    found = lines.withColumn("p", problem(F.col(line))).where("p is not null").select(*([ts] if ts else []), "p.*")
    if ts:
        return found.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(FIELDS))
    return found.dropDuplicates(list(FIELDS))


def event_counts(events: DataFrame, ts: str, kind: str, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by window and kind; late events are let in up to the delay."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, delay).groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    by = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def cached_values(updates: DataFrame, key: str, value: str, hours: float = 4) -> DataFrame:
    """The latest value of each key, and an expiry row when it has not been renewed within its time to live."""
    kind = dict(updates.dtypes)

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], value: [last], "expired": [True]})
            return
        last = None
        for p in parts:
            last = p[value].iloc[-1]
        state.update((last,))
        state.setTimeoutDuration(int(hours * 3_600_000))
        yield pd.DataFrame({key: [k[0]], value: [last], "expired": [False]})

    return updates.select(key, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {value} {kind[value]}, expired boolean", f"{value} {kind[value]}", "append", GroupStateTimeout.ProcessingTimeTimeout)
