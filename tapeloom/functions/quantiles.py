"""Exact quantiles without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 2000
MARGIN = 0.002


def exact_quantiles(long: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``probs``, and ``n``.

    A sketch with a known rank error brackets each target rank, and the bracket is widened by the
    next value on either side, so it holds both ranks in groups of any size. Rows under the
    bracket are only counted; those inside are reduced to a row per distinct value before they
    are ordered. So neither a large group nor a value that fills one meets in a task.
    """
    rows = long.where(F.col(value).isNotNull())
    v = F.col(value)

    def edge(q, outer):
        return F.percentile_approx(value, F.lit(q), F.lit(ACCURACY)) if 0 < q < 1 else outer

    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[edge(p - MARGIN, F.min(value)).alias(f"_lo_{q}") for q, p in probs.items()],
        *[edge(p + MARGIN, F.max(value)).alias(f"_hi_{q}") for q, p in probs.items()],
    )
    under = rows.join(sketch, keys).groupBy(*keys).agg(
        *[F.count_if(v < F.col(f"_lo_{q}")).alias(f"_below_{q}") for q in probs],
        *[F.max(F.when(v < F.col(f"_lo_{q}"), v)).alias(f"_prev_{q}") for q in probs],
        *[F.min(F.when(v > F.col(f"_hi_{q}"), v)).alias(f"_next_{q}") for q in probs],
    )
    brackets = sketch.join(under, keys).select(*keys, F.explode(F.array(*[
        F.struct(F.lit(q).alias("q"), F.lit(float(p)).alias("p"), F.col(f"_lo_{q}").alias("lo"), F.col(f"_below_{q}").alias("below"), F.col("n").alias("n"),
                 F.coalesce(f"_prev_{q}", f"_lo_{q}").alias("least"), F.coalesce(f"_next_{q}", f"_hi_{q}").alias("most"))
        for q, p in probs.items()
    ])).alias("b")).select(*keys, "b.*")
    inside = rows.select(*keys, value).join(brackets, keys).where(v.between(F.col("least"), F.col("most")))
    values = inside.groupBy(*keys, "q", value).agg(F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in ("p", "lo", "below", "n")])
    one = Window.partitionBy(*keys, "q")
    lower = F.coalesce(F.sum(F.when(v < F.col("lo"), F.col("c"))).over(one), F.lit(0))
    upto = F.sum("c").over(one.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("_end", F.col("below") - lower + upto).withColumn("_t", F.col("p") * (F.col("n") - 1))
    holds = lambda r: ((F.col("_end") - F.col("c") <= r) & (r < F.col("_end"))).cast("int")
    part = F.col("_t") - F.floor("_t")
    weight = holds(F.floor("_t")) * (1 - part) + holds(F.floor("_t") + 1) * part
    picked = ranked.where(weight > 0).groupBy(*keys, "q", "n").agg(F.sum(weight * v).alias("v"))
    return picked.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(q) for q in probs])
