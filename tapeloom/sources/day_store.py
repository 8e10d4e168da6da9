"""Tables stored by day, whose days are replaced as a whole and in one step.

Rows lie in folders of (version, day). A version counts from the moment its commit, one small file,
is in place: until then readers see the days as they were, after it all of the new ones. The commits
are the ledger too: they name the source and batch that made a version, so a batch that is delivered again is
known and changes nothing, and older versions stay readable. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tapeloom.operators.calendar import inclusive
from tapeloom.schemas import Record
from tapeloom.sources.tables import upsert


class DayStore:
    """``schema`` without the version; ``date`` names its day column."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, date: str = "trade_date"):
        self.spark, self.schema, self.date = spark, schema, date
        self.days, self.commits = f"{path}/days", f"{path}/commits"

    def _stored(self, path: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise  # an unreadable table is no empty table
            return self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, version: int, source: str | None = None, batch: int | None = None) -> None:
        """Store the days of ``rows`` as ``version``; the same version again replaces what it wrote."""
        folder = f"{self.days}/version={version}"
        rows.select(*self.schema.fieldNames()).repartition(self.date).write.mode("overwrite").partitionBy(self.date).parquet(folder)
        counts = self.spark.read.schema(self.schema).parquet(folder).groupBy(self.date).agg(F.count(F.lit(1)).alias("n"))
        told = counts.select(self.date, "n", F.lit(source).cast("string").alias("source"), F.lit(batch).cast("long").alias("batch"))
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.commits}/version={version}")

    def versions(self, start=None, end=None) -> DataFrame:
        """(day, n, source, batch, version): what was committed, a row per day and version."""
        return inclusive(self._stored(self.commits, f"{self.date} date, n long, source string, batch long, version int"), start, end, self.date)

    def read(self, start=None, end=None, upto: int | None = None) -> DataFrame:
        """The newest version (up to ``upto``) of every day in the range. Only these days' folders are opened: the
        bounds prune them, and the join with the commits prunes the versions."""
        known = self.versions(start, end)
        if upto is not None:
            known = known.where(F.col("version") <= upto)
        newest = known.groupBy(self.date).agg(F.max("version").alias("version"))
        stored = self._stored(self.days, StructType([*self.schema.fields, StructField("version", IntegerType())]))
        return inclusive(stored, start, end, self.date).join(newest, [self.date, "version"]).select(*self.schema.fieldNames())

    def upsert(self, rows: DataFrame, record: Record, sequence: str | None = None, source: str = "", batch: int | None = None) -> bool:
        """Insert or replace by primary key, rewriting only the days that ``rows`` touch; False if this batch of
        this source is in the ledger already.

        Within the batch the row with the largest ``sequence`` wins. Without one a key must not come twice
        with different rows.
        """
        ledger = self.versions()
        if batch is not None and not ledger.where((F.col("source") == source) & (F.col("batch") == batch)).isEmpty():
            return False
        last = ledger.agg(F.max("version").alias("v")).first().v
        touched = rows.select(F.to_date(F.substring(F.col(self.date).cast("string"), 1, 10)).alias(self.date)).distinct()
        current = self.read().join(touched, self.date, "left_semi")
        self.write(upsert(current, [rows], record, sequence), 0 if last is None else last + 1, source, batch)
        return True
