"""Reading, upserting and maintaining record tables stored as Parquet."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.schemas import Record, conform


def read_table(spark: SparkSession, path: str, record: Record) -> DataFrame:
    """Read with the declared schema, so nothing is inferred from the files."""
    return spark.read.schema(record.schema).parquet(path)


def load(df: DataFrame, code: str | None = None, start=None, end=None, columns: list[str] | None = None, date: str = "trade_date") -> DataFrame:
    """Rows of a code in an inclusive date range, by date; every filter reaches the scan."""
    if code is not None:
        df = df.where(F.col("code") == code)
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return (df.select(*columns) if columns else df).orderBy(date)


def date_ranges(df: DataFrame, keys: list[str], date: str = "trade_date") -> DataFrame:
    """(min, max, row count) of the dates per key; no keys for the whole table."""
    return df.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n"))


def has_rows(df: DataFrame, **equals) -> bool:
    for name, value in equals.items():
        df = df.where(F.col(name) == value)
    return not df.isEmpty()


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the largest ``order`` per key.

    Expressed as an aggregate with map-side combine rather than a ranking window, so many
    copies of one key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*df.columns)


def upsert(current: DataFrame, incoming: list[DataFrame], record: Record, sequence: str | None = None) -> DataFrame:
    """Insert or replace by primary key; later batches win, and within a batch the row with the largest
    ``sequence``, a column of the batches. Without one a key that comes twice in a batch with
    different rows is an error, as nothing says which was written last."""
    rest = F.struct(*[c for c in record.columns if c not in record.pk])
    out = conform(current, record).select("*", F.lit(0).alias("_batch"), F.lit(None).cast("long").alias("_seq"))
    for i, batch in enumerate(incoming, start=1):
        keyed = batch.withColumn("_seq", F.lit(None).cast("long") if sequence is None else F.col(sequence))
        out = out.unionByName(conform(keyed, replace(record, ddl=f"{record.ddl}, _seq long")).withColumn("_batch", F.lit(i)))
    # rows of equal sequence fall back on their values, so that a run again agrees
    best = F.max_by(rest, F.struct("_batch", "_seq", rest))
    if sequence is None:
        twice = [F.min(F.when(F.col("_batch") == i, rest)) != F.max(F.when(F.col("_batch") == i, rest)) for i in range(1, len(incoming) + 1)]
        unclear = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in twice], F.lit(False))
        best = F.when(unclear, F.raise_error(F.lit(f"{record.table}: a key comes twice in a batch without a sequence"))).otherwise(best)
    return out.groupBy(*record.pk).agg(best.alias("_r")).select(*record.pk, "_r.*").select(*record.columns)


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_days(df: DataFrame, path: str, date: str = "trade_date") -> None:
    """Replace exactly the day partitions present in ``df``; other days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def apply_upsert(spark: SparkSession, path: str, batch: DataFrame, record: Record, date: str = "trade_date", sequence: str | None = None) -> None:
    """Upsert into a table partitioned by date, rewriting only the days the batch touches.

    The touched days are computed from the batch by a semi join, never collected. Days are replaced one
    after the other; where readers must not see some new and some old, use ``DayStore``.
    """
    from pyspark.errors import AnalysisException

    from tapeloom.session import scratch_dir

    try:
        current = spark.read.schema(record.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # an unreadable table is no empty table
        current = spark.createDataFrame([], record.schema)
    touched = conform(batch, record).select(date).distinct()
    merged = upsert(current.join(touched, date, "left_semi"), [batch], record, sequence)
    # written aside first: the merge reads the partitions it replaces
    staged = scratch_dir(spark, "upsert")
    merged.write.parquet(staged)
    replace_days(spark.read.schema(merged.schema).parquet(staged), path, date)


def update_watermarks(marks: DataFrame, loaded: DataFrame, source: str) -> DataFrame:
    """High-water date per code: the larger of the stored date and the newest loaded one."""
    new = loaded.groupBy("code").agg(F.max("trade_date").alias("last_date")).withColumn("source", F.lit(source))
    both = marks.select("code", "last_date", "source").unionByName(new)
    return last_per_key(both, ["code"], [F.col("last_date"), F.col("source")])


def repair_mixed_dates(df: DataFrame, pk: list[str], date: str = "trade_date") -> DataFrame:
    """Rewrite 'date time' text to ISO 'dateTtime'; when the key already exists in ISO form
    that row stays and the rewritten one is dropped."""
    dirty = F.col(date).contains(" ")
    fixed = df.withColumn("_clean", (~dirty).cast("int")).withColumn(date, F.regexp_replace(date, " ", "T"))
    rest = [c for c in df.columns if c not in pk]
    tie = F.struct(*rest) if rest else F.lit(0)
    return last_per_key(fixed, pk, [F.col("_clean"), tie]).drop("_clean")


def repair_counts(df: DataFrame, pk: list[str], date: str = "trade_date") -> DataFrame:
    """How many rows the repair inserts (new ISO keys) and deletes (rows with a space)."""
    dirty = F.col(date).contains(" ")
    keyed = df.withColumn("_dirty", dirty).withColumn(date, F.regexp_replace(date, " ", "T"))
    per = keyed.groupBy(*pk).agg(F.count_if("_dirty").alias("d"), F.count_if(~F.col("_dirty")).alias("c"))
    return per.agg(F.count_if((F.col("d") > 0) & (F.col("c") == 0)).alias("inserted"), F.coalesce(F.sum("d"), F.lit(0)).alias("deleted"))


def latest_runs(runs: DataFrame, n: int, started: str = "started_at", **equals) -> DataFrame:
    for name, value in equals.items():
        runs = runs.where(F.col(name) == value)
    return runs.orderBy(F.col(started).desc(), F.col("run_id").desc()).limit(n)


def run_metrics(metrics: DataFrame, run_id: str) -> DataFrame:
    return metrics.where(F.col("run_id") == run_id).orderBy("epoch")


def record_best(runs: DataFrame, metrics: DataFrame, value: str) -> DataFrame:
    """Best metric and its epoch (the earliest on ties) per run, next to the run row."""
    best = metrics.groupBy("run_id").agg(
        F.max(value).alias("best_metric"), F.max_by("epoch", F.struct(F.col(value), -F.col("epoch"))).alias("best_epoch"))
    return runs.drop("best_metric", "best_epoch").join(best, "run_id", "left")


def delete_run(table: DataFrame, run_id: str) -> DataFrame:
    return table.where(F.col("run_id") != run_id)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result files as CSV (with header), JSON or Parquet, in parallel parts."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
