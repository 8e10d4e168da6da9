"""Mixing sources to target weights by weighted sampling without replacement, in SQL functions only.

A source's target is its share of all words by weight, held to ``most`` times its own size with
the excess shared anew (water filling, in closed form over one row per source). A source first
gives complete epochs of all its documents; what is left of the target is filled by documents in
the order of Efraimidis-Spirakis keys ``-ln(u) / quality``, ``u`` being drawn from the
document's id, until the prefix sum of their words comes nearest to it.

The order within a source is a distributed sort: rows are dealt by range of (source, key), so a
source with a third of all rows fills a third of the ranges. Prefix sums run inside a range and
start from the sums of the ranges before it, of which there is a row per (source, range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import WORD, staged

#: Weights of the sources in code-point order, repeating.
SOURCE_WEIGHTS = (5, 2, 1)
#: Characters that count against a document's quality weight.
SYMBOLS = "#*$%&|<>!"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for a text without symbols, falling to 0.1 where every tenth character is one."""
    chars = F.length(text)
    symbols = chars - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(chars > 0, F.greatest(F.lit(0.1), 1.0 - symbols * 10.0 / chars)).otherwise(F.lit(0.1))


def uniform(name: Column) -> Column:
    """A number in (0, 1) drawn from a value: 52 bits of its md5."""
    digits = F.substring(F.md5(F.coalesce(name.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4503599627370496.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size) with one row per source -> the same with ``target`` (double).

    A source is held to ``most`` times its size if its uncapped share passes that. In the order of
    cap per weight the held sources come first; a source is held exactly if its cap per weight is
    below the share per weight of all that are not held before it.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    capped = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", "rank")
    before, onward, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    held = capped.withColumn("level", level).withColumn("held", F.col("ratio") <= F.col("level"))
    share = F.max(F.when(~F.col("held"), F.col("level"))).over(whole)  # the first that is not held: levels fall after it
    return held.select("source", "source_size", F.when(F.col("held"), F.col("cap")).otherwise(share * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, most: int = 3, size: Column | None = None, quality: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, sampling_key for every row of ``docs``
    (doc_id, text, source).

    ``size`` and ``quality`` may be given as expressions over ``docs``; by default words and
    symbol share of the text. A null text has size 0; a null source is a source of its own, after
    all others; sizes of 0 are never taken and a source without words has target 0. Rows that
    repeat an id draw the same number and are ordered by their size: equal rows are
    interchangeable, so the result is the same multiset in every run. An empty table gives an
    empty result; other columns are ignored.
    """
    size = word_count(F.col("text")) if size is None else size.cast("long")
    quality = quality_weight(F.col("text")) if quality is None else quality
    keyed = docs.select("doc_id", "source", size.alias("size"), (-F.log(uniform(F.col("doc_id"))) / quality).alias("sampling_key"))
    ordered = keyed.repartitionByRange(F.col("source").asc_nulls_last(), "sampling_key", "doc_id").withColumn("range", F.spark_partition_id())
    ordered = staged(ordered, "mixing")

    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("name")
    ranges = ordered.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most)
    plan = offsets.select(named, "range", "offset").join(targets.select(named, "source_size", "target"), "name")

    inside = W.partitionBy("source", "range").orderBy("sampling_key", F.col("doc_id").asc_nulls_last(), "size")
    prefix = ordered.withColumn("inside", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    mixed = prefix.select("*", named).join(plan, ["name", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    more = (F.col("offset") + F.col("inside") + F.col("size") / 2.0 <= rest).cast("long")
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (epochs + more)).alias("taken"), (epochs + more).alias("copies"), "sampling_key")
