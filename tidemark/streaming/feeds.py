"""Incremental ingest, a rollup of late-tolerant periods and a running accuracy monitor."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.periods import align_period, check_frequency, shift_period
from ..operators.metrics import error_sums, merge_sums, metric_columns


def stream_folder(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", per_trigger: int | None = None, **options
) -> DataFrame:
    """New files of a folder with the file and its time as provenance.

    ``per_trigger`` bounds the files of one micro-batch, so a large backlog is read in
    several batches of even size.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = reader.options(**options).load(path)
    return rows.select(
        "*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("source_time")
    )


def stream_period_rollup(stream: DataFrame, freq: str, lateness: str, ts: str = "ts", value: str = "target") -> DataFrame:
    """Target per item and period, emitted once the watermark has passed the period.

    Days and weeks are tumbling windows over event time. Months differ in length, so there
    the start of the month is the event time: a month closes when a month that starts more
    than ``lateness`` later has begun.
    """
    check_frequency(freq)
    when = F.col(ts).cast("timestamp")
    sums = [F.sum(value).alias("target"), F.count("*").alias("source_rows")]
    if freq == "monthly":
        seen = stream.withColumn("__month", F.date_trunc("month", when)).withWatermark("__month", lateness)
        rolled = seen.groupBy("item_id", "__month").agg(*sums)
        return rolled.select("item_id", F.col("__month").cast("date").alias("period"), "target", "source_rows")
    seen = stream.withColumn("__at", when).withWatermark("__at", lateness)
    # seven-day windows start on Thursday 1970-01-01; Monday is four days later
    window = F.window("__at", "1 day") if freq == "daily" else F.window("__at", "7 days", startTime="4 days")
    rolled = seen.groupBy("item_id", window.alias("w")).agg(*sums)
    return rolled.select("item_id", F.col("w.start").cast("date").alias("period"), "target", "source_rows")


CLOSED = "item_id string, period date, kind string, target double, source_rows long"


def stream_closed_periods(
    stream: DataFrame, freq: str, lateness_days: int, ts: str = "ts", value: str = "target", shards: int = 1
) -> DataFrame:
    """Closed periods of every item, and what came too late for them; nothing is lost.

    Each item has a clock of its own: the newest time seen in earlier micro-batches, less the lateness. A
    period that ends by then is closed: its sum is emitted once, as ``closed``, and rows that arrive
    for it afterwards are emitted as ``late``, added up per micro-batch. Both kinds together are the
    sums of all rows of the closed periods. The state of an item is its open periods. ``shards`` deals
    a busy item's rows to several states with clocks of their own; add their rows up again by item and period.
    """
    check_frequency(freq)
    when = F.col(ts).cast("timestamp")
    period = align_period(when.cast("date"), freq)
    rows = stream.select(
        "item_id", F.pmod(F.xxhash64(ts, value), F.lit(shards)).alias("shard"), when.alias("at"), period.alias("period"),
        shift_period(period, freq, 1).alias("end"), F.col(value).cast("double").alias("value"),
    ).filter(F.col("item_id").isNotNull() & F.col("at").isNotNull() & F.col("value").isNotNull())
    grace = pd.Timedelta(days=lateness_days)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, open_ = json.loads(state.get[0]) if state.exists else (None, {})
        clock = pd.Timestamp(newest) - grace if newest else pd.Timestamp.min
        late: dict[str, list] = {}
        for rows in batches:
            codes, starts = pd.factorize(rows["period"])
            sums, counts = np.bincount(codes, weights=rows["value"].fillna(0.0)), np.bincount(codes)
            ends = rows["end"].to_numpy()[np.unique(codes, return_index=True)[1]]
            for start, end, value_sum, n in zip(starts, ends, sums, counts):
                held = late if pd.Timestamp(end) <= clock else open_
                total = held.setdefault(str(start), [str(end), 0.0, 0])
                total[1] += float(value_sum)
                total[2] += int(n)
            top = str(rows["at"].max())
            newest = top if newest is None or pd.Timestamp(top) > pd.Timestamp(newest) else newest
        clock = pd.Timestamp(newest) - grace
        done = {p: open_.pop(p) for p in list(open_) if pd.Timestamp(open_[p][0]) <= clock}
        state.update((json.dumps([newest, open_]),))
        out = [(p, "closed", v, n) for p, (_, v, n) in done.items()] + [(p, "late", v, n) for p, (_, v, n) in late.items()]
        yield pd.DataFrame({
            "item_id": [key[0]] * len(out), "period": [pd.Timestamp(x[0]).date() for x in out], "kind": [x[1] for x in out],
            "target": [x[2] for x in out], "source_rows": [x[3] for x in out],
        })

    return rows.groupBy("item_id", "shard").applyInPandasWithState(
        advance, CLOSED, "held string", "append", GroupStateTimeout.NoTimeout
    )


def stream_actuals(actuals: DataFrame, forecast: DataFrame, keys: list[str] = ("item_id",)) -> DataFrame:
    """Running error sums of arriving actuals against a fixed forecast.

    The forecast is a plain table; each micro-batch joins it on item and date. Use update
    or complete mode, or ``monitor_sink``.
    """
    fixed = forecast.select("item_id", "ts", F.col("mean").alias("pred"))
    return error_sums(actuals.join(fixed, ["item_id", "ts"]), list(keys))


def running_metrics(sums: DataFrame, keys: list[str] = ("item_id",)) -> DataFrame:
    merged = merge_sums(sums, list(keys))
    return merged.select(*keys, *[c.alias(name) for name, c in metric_columns().items()])


def monitor_sink(forecast: DataFrame, path: str, keys: list[str] = ("item_id",)) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: error sums of each batch, written under its number.

    A batch that is run again overwrites its own folder, so every actual counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stream_actuals(batch, forecast, keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Process everything that is there, then stop."""
    query = (
        df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query
