"""Table integrity checks. All take an explicit ``as_of`` instead of the wall clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import completeness_grade, is_special_treatment


def _recent(df: DataFrame, as_of, days: int) -> DataFrame:
    if not days:
        return df
    return df.where(F.col("trade_date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def _stacked(tables: dict[str, DataFrame], as_of, days: int) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = _recent(df.select("code", "trade_date"), as_of, days).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_keys(tables: dict[str, DataFrame], as_of, days: int = 30) -> DataFrame:
    """All keys held more than once, with their count."""
    counts = _stacked(tables, as_of, days).groupBy("table", "code", "trade_date").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1")


def worst_duplicates(duplicates: DataFrame, per_table: int = 1000) -> DataFrame:
    """The report for a reader: the ``per_table`` most repeated keys of each table."""
    w = Window.partitionBy("table").orderBy(F.col("n").desc(), "code", "trade_date")
    return duplicates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_table).drop("rank")


def missing_pairs(base: DataFrame, children: dict[str, DataFrame], as_of, days: int = 30, exclude_suffix: tuple[str, ...] = (".BJ",)) -> DataFrame:
    """How many (code, date) pairs of the base each child table lacks; complete children are
    not listed. Presence of all children is counted in one shuffle of the stacked keys."""
    rows = _recent(base.select("code", "trade_date"), as_of, days)
    for s in exclude_suffix:
        rows = rows.where(~F.col("code").endswith(s))
    own = rows.groupBy("code", "trade_date").agg(F.count(F.lit(1)).alias("base_rows")).withColumn("child", F.lit(None).cast("string"))
    stacked = own
    for name, df in children.items():
        part = _recent(df.select("code", "trade_date"), as_of, days).select(
            "code", "trade_date", F.lit(None).cast("bigint").alias("base_rows"), F.lit(name).alias("child"))
        stacked = stacked.unionByName(part)
    pairs = stacked.groupBy("code", "trade_date").agg(
        F.sum("base_rows").alias("base_rows"),
        *[F.max(F.when(F.col("child") == n, 1)).alias(f"has_{i}") for i, n in enumerate(children)],
    ).where(F.col("base_rows").isNotNull())
    lacking = pairs.agg(*[F.sum(F.when(F.col(f"has_{i}").isNull(), F.col("base_rows"))).alias(n) for i, n in enumerate(children)])
    return lacking.unpivot([], list(children), "child", "missing").where("missing > 0")


def calendar_gaps(bars: DataFrame, codes: DataFrame, as_of, days: int = 1825, min_gap: int = 1) -> DataFrame:
    """Codes with fewer dates than the calendar has since their first one."""
    recent = _recent(bars.select("code", "trade_date"), as_of, days)
    cal = recent.select("trade_date").distinct()
    ahead = cal.select("trade_date", F.row_number().over(Window.orderBy(F.col("trade_date").desc())).alias("expected_days"))
    per = recent.join(codes.select("code").distinct(), "code", "left_semi").groupBy("code").agg(
        F.count_distinct("trade_date").alias("actual_days"), F.min("trade_date").alias("first_day")
    )
    out = per.join(ahead.withColumnRenamed("trade_date", "first_day"), "first_day")
    return out.where(F.col("expected_days") - F.col("actual_days") >= min_gap).select(
        "code", "actual_days", F.col("expected_days").cast("bigint").alias("expected_days"), "first_day")


def row_count_jumps(bars: DataFrame, as_of, days: int = 30, max_change: float = 0.05) -> DataFrame:
    per = _recent(bars, as_of, days).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_today"))
    w = Window.orderBy("trade_date")  # one row per trading day
    out = per.select("trade_date", "n_today", F.lag("trade_date").over(w).alias("prev_date"), F.lag("n_today").over(w).alias("n_prev"))
    change = F.try_divide(F.col("n_today") - F.col("n_prev"), F.col("n_prev"))
    return out.withColumn("change_pct", change).where(F.abs("change_pct") > max_change)


def status_grid(tables: dict[str, DataFrame], expected: dict[str, int], as_of, days: int = 7) -> DataFrame:
    """Distinct codes per table and calendar day of the last ``days`` days, graded."""
    spark = next(iter(tables.values())).sparkSession
    end = F.lit(as_of).cast("date")
    counts = _stacked(tables, as_of, days - 1).where(F.col("trade_date") <= end).groupBy("table", F.col("trade_date").alias("day")).agg(
        F.count_distinct("code").alias("codes"))
    want = spark.createDataFrame([(t, expected[t]) for t in tables], "table string, expected bigint")
    grid = want.select("table", "expected", F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    out = grid.join(counts, ["table", "day"], "left").fillna(0, ["codes"])
    return out.select("table", "day", "codes", completeness_grade(F.col("codes"), F.col("expected")).alias("severity"))


def integrity_summary(dups: DataFrame, missing: DataFrame, jumps: DataFrame) -> DataFrame:
    """One row per check with the number of findings and the worst one."""
    a = dups.agg(F.lit("duplicates").alias("check"), F.count(F.lit(1)).alias("issues"), F.max_by(F.concat_ws("/", "table", "code"), F.struct("n", "table", "code")).alias("worst"))
    b = missing.agg(F.lit("missing_pairs").alias("check"), F.coalesce(F.sum("missing"), F.lit(0)).alias("issues"), F.max_by("child", F.struct("missing", "child")).alias("worst"))
    c = jumps.agg(F.lit("row_count_jumps").alias("check"), F.count(F.lit(1)).alias("issues"), F.max_by(F.col("trade_date").cast("string"), F.struct(F.abs("change_pct"), "trade_date")).alias("worst"))
    return a.unionByName(b).unionByName(c)


def table_counts(tables: dict[str, DataFrame | None], spark) -> DataFrame:
    """Row count of every table, 0 for an absent one."""
    out = spark.createDataFrame([(n, 0) for n, df in tables.items() if df is None], "table string, n bigint")
    for name, df in tables.items():
        if df is not None:
            out = out.unionByName(df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")))
    return out


DONE_STATES = ("实施", "已实施")


def ex_dividend_codes(dividend: DataFrame, day) -> DataFrame:
    """Codes going ex-dividend on the day; ``ex_date`` may be a date or ISO text."""
    return dividend.where((F.to_date("ex_date") == F.lit(day).cast("date")) & F.col("div_proc").isin(*DONE_STATES)).select("code").distinct()


def suspended_codes(universe: DataFrame, panel: DataFrame, day) -> DataFrame:
    active = panel.where(F.col("trade_date") == F.lit(day).cast("date")).select("code")
    return universe.select("code").distinct().join(active, "code", "left_anti")


def trading_mask(universe: DataFrame, panel: DataFrame, lifecycle: DataFrame, dividend: DataFrame, day) -> DataFrame:
    """Masked codes with their reasons in the order ST, ex_dividend, suspended."""
    st = lifecycle.where(is_special_treatment(F.col("name"))).select("code")
    parts = [("ST", 0, st), ("ex_dividend", 1, ex_dividend_codes(dividend, day)), ("suspended", 2, suspended_codes(universe, panel, day))]
    flags = None
    for reason, pos, df in parts:
        one = df.select("code", F.struct(F.lit(pos).alias("p"), F.lit(reason).alias("reason")).alias("r"))
        flags = one if flags is None else flags.unionByName(one)
    flags = flags.join(universe.select("code").distinct(), "code", "left_semi")
    return flags.groupBy("code").agg(F.transform(F.array_sort(F.collect_set("r")), lambda s: s["reason"]).alias("reasons"))


def mask_summary(mask: DataFrame) -> DataFrame:
    return mask.agg(
        F.count(F.lit(1)).alias("masked"),
        *[F.count_if(F.array_contains("reasons", r)).alias(f"n_{r.lower()}") for r in ("ST", "ex_dividend", "suspended")],
    )


def affected_factor_history(factors: DataFrame, dividend: DataFrame, day) -> DataFrame:
    """All factor rows of the codes with an ex-dividend event that day: these must be refreshed."""
    return factors.join(ex_dividend_codes(dividend, day), "code", "left_semi")


def deterministic_sample(codes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n codes picked by a seeded hash order, the same on every run and cluster."""
    return codes.select("code").distinct().orderBy(F.md5(F.concat_ws(":", F.col("code"), F.lit(str(seed)))), "code").limit(n)
