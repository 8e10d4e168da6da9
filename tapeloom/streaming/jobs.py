"""Structured Streaming jobs over append-only files, each with a batch twin elsewhere.

Sources are file folders, sinks are Parquet folders or ``foreachBatch``; state and progress
live in a checkpoint folder that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tapeloom.schemas import Record
from tapeloom.session import scratch_dir
from tapeloom.sources.day_store import DayStore

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def as_timestamp(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time must be an instant; zone-less timestamps are read in the session zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def run_to_files(stream: DataFrame, label: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run everything available into a Parquet folder and return what was written. A ``folder`` that was run into
    before goes on from its checkpoint."""
    spark = stream.sparkSession
    out = folder or scratch_dir(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_in_parts(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """The output of ``build`` over files that arrive part by part: the stream ends when it has read a part and is
    started again, from its checkpoint, for the next one. State and watermark go on, so a row is late by what earlier
    parts held."""
    spark = parts[0].sparkSession
    base, out = scratch_dir(spark, label), None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/arrived")
        out = run_to_files(build(read_files(spark, f"{base}/arrived", part.schema)), label, folder=base)
    return out


def upsert_files(stream: DataFrame, store: DayStore, record: Record, checkpoint: str, sequence: str | None = None, source: str = "files") -> None:
    """Files into a table keyed by the record, in the order of the micro-batches; within one the largest
    ``sequence`` wins. The store's ledger names ``source`` and batch, so a batch that is delivered again, after a failure or
    from a fresh checkpoint, changes nothing. Another stream into the same table needs another ``source``."""

    def merge(batch: DataFrame, number: int) -> None:
        store.upsert(batch, record, sequence, source, number)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_in_parts(parts: list[DataFrame], store: DayStore, record: Record, label: str, sequence: str | None = None, source: str = "files") -> None:
    """One delivery of the parts, from a fresh checkpoint: the files of a part, as many as tasks wrote, are one micro-batch,
    for the stream ends when it has read a part and is started again for the next one."""
    spark = parts[0].sparkSession
    base = scratch_dir(spark, label)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/arrived")
        upsert_files(read_files(spark, f"{base}/arrived", part.schema), store, record, f"{base}/checkpoint", sequence, source)


def counter_kpis(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count, sum and mean per scope, name and tumbling window; events later than the delay
    are dropped."""
    return (
        as_timestamp(events).withWatermark("ts", delay).groupBy(F.window("ts", window), "scope", "name")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
        .select(F.col("window.start").alias("window_start"), "scope", "name", "n", "total", "mean")
    )


def ohlcv_bars(ticks: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Ticks (code, ts, price, volume, seq) to tumbling bars, or sliding ones with ``slide``."""
    key = F.struct("ts", "seq")
    return (
        as_timestamp(ticks).withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "code")
        .agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
             F.max_by("price", key).alias("close"), F.sum("volume").alias("volume"))
        .select(F.col("window.start").alias("bar_start"), "code", "open", "high", "low", "close", "volume")
    )


def run_sessions(events: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Events of a run id that follow each other within the gap form one session."""
    return (
        as_timestamp(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "run_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select("run_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "total")
    )


def drop_repeats(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """First occurrence of each event id within the delay."""
    return as_timestamp(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


class _Recursive(StatefulProcessor):
    """Per code: EWM of the close, length of the rising streak, rows since the last big rise. Rows dated up
    to the last one seen are too late to count and are left out, so a repeated row changes nothing."""

    def __init__(self, alpha: float, jump: float, cap: int):
        self.alpha, self.jump, self.cap = alpha, jump, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("s", "y double, last double, streak int, since int, day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        y, last, streak, since, day = self.state.get() if self.state.exists() else (None, None, 0, self.cap, 0)
        df = pd.concat(list(rows)).sort_values("trade_date").drop_duplicates("trade_date")
        days = df["trade_date"].map(lambda d: d.toordinal())
        df, day = df[days > day], max(day, int(days.max()))
        ys, streaks, sinces = [], [], []
        for x in df["close"]:
            y = x if y is None else (1 - self.alpha) * y + self.alpha * x
            change = None if last is None else x / last - 1
            streak = streak + 1 if change is not None and change > 0 else 0
            since = 0 if change is not None and change >= self.jump else min(since + 1, self.cap)
            last = x
            ys.append(y)
            streaks.append(streak)
            sinces.append(since)
        if ys:
            self.state.update((float(y), float(last), int(streak), int(since), day))
        yield pd.DataFrame({"code": key[0], "trade_date": df["trade_date"].to_numpy(), "ewm": ys, "streak": streaks, "since": sinces})

    def close(self) -> None:
        pass


def recursive_indicators(bars: DataFrame, alpha: float = 1 / 12, jump: float = 0.095, cap: int = 60) -> DataFrame:
    """Recursive indicators carried across micro-batches in keyed state (a few numbers per code)."""
    return bars.groupBy("code").transformWithStateInPandas(
        statefulProcessor=_Recursive(alpha, jump, cap),
        outputStructType="code string, trade_date date, ewm double, streak int, since int",
        outputMode="append", timeMode="none")


def with_rocksdb(spark: SparkSession, body: Callable[[], DataFrame]) -> DataFrame:
    """Run ``body`` with the state store that keyed Python state needs, then restore the setting."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        return body()
    finally:
        spark.conf.set(name, before)
