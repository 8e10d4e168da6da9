"""Ranks, prefix sums and correlations that never gather an unbounded group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import store_once


def average_rank(c: Column | str, keys: list[str]) -> Column:
    """Rank with ties sharing their mean rank, inside a group bounded by its key
    (one row per instrument and date)."""
    c = F.col(c) if isinstance(c, str) else c
    order = Window.partitionBy(*keys).orderBy(c)
    ties = Window.partitionBy(*keys, c)
    return F.when(c.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def running_totals(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], sums: dict[str, str]
) -> DataFrame:
    """Running sums in ``order`` inside each key group, in two levels.

    ``bucket`` must grow with ``order``. Rows are summed per (key, bucket) with map-side
    combine, the small bucket totals are accumulated, and only the rows of one bucket ever
    share a task, so a key that holds a third of all rows is spread over its buckets.
    """
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(*keys, "_bucket").agg(
        *[F.sum(F.col(src)).alias(f"_t_{name}") for name, src in sums.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(totals, [*keys, "_bucket"])
    return joined.withColumns(
        {n: F.coalesce(F.sum(src).over(inside), F.lit(0)) + F.col(f"_o_{n}") for n, src in sums.items()}
    ).drop("_bucket", *[f"_o_{n}" for n in sums])


def range_totals(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Running sums in the order of one column, this row included, as columns named by ``sums``.

    Rows are dealt by range of ``order``; a range's sums start from the totals of those before it, of which there
    is a row per range. The number of ranges is that of the shuffle's partitions, which follows the rows. The dealt rows are
    stored, so that a range means the same rows wherever it is used.
    """
    ranged = store_once(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(before, "_range").withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{n}") for n, c in sums.items()})
    return out.drop("_range", *[f"_o_{n}" for n in sums])
