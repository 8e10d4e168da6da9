"""The training cube of a phase: two levels of tokens, dense days, features in array blocks.

Phase 1 has the industry indexes, phase 2 those and the stocks of a universe, phase 3 the stocks alone
with open, high, low and a hit label. Both asset classes go through one feature computation and are
normalised apart, each among its own kind and day. ``cube_blocks`` lays a day's tokens out in
array columns, a row per day and run of tokens, which ``write_cube`` stores by day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators.calendar import dense_grid, trading_calendar
from tapeloom.operators.features import ALL_SOURCES, FEATURES, FeatureSource, attach_mentions, compute_features, zscore_by_day
from tapeloom.operators.labels import with_hit_labels
from tapeloom.operators.panel import PRICES, attach_forward_adjusted, index_as_panel

INDUSTRY, STOCK = 0, 1
PHASES = {1: (INDUSTRY,), 2: (INDUSTRY, STOCK), 3: (STOCK,)}


def index_bars(bars: DataFrame, industry: DataFrame) -> DataFrame:
    """Equal-weighted bars per industry; the index's code is the industry's."""
    means = [F.avg(c).alias(c) for c in PRICES]
    joined = bars.join(industry.select("code", "l1_code"), "code")
    out = joined.groupBy("l1_code", "trade_date").agg(*means, F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))
    return out.withColumnRenamed("l1_code", "code")


def token_index(industry: DataFrame, universe: DataFrame | None, phase: int) -> DataFrame:
    """(token_idx, code, token_type, industry_id): the industries by code, then the stocks by code. A stock
    of no known industry has industry 0. The windows here run over a row per token."""
    ids = industry.where(F.col("l1_code").isNotNull()).select("l1_code").distinct()
    ids = ids.withColumn("industry_id", (F.row_number().over(Window.orderBy("l1_code")) - 1).cast("int"))
    own = ids.select(F.lit(INDUSTRY).alias("token_type"), F.col("l1_code").alias("code"), "industry_id")
    if STOCK in PHASES[phase]:
        held = universe.select("code").distinct().join(industry.select("code", "l1_code"), "code", "left").join(ids, "l1_code", "left")
        stocks = held.select(F.lit(STOCK).alias("token_type"), "code", F.coalesce("industry_id", F.lit(0)).alias("industry_id"))
        own = own.unionByName(stocks) if INDUSTRY in PHASES[phase] else stocks
    place = F.row_number().over(Window.orderBy("token_type", "code")) - 1
    return own.select(place.cast("int").alias("token_idx"), "code", "token_type", "industry_id")


def phase_panel(tokens: DataFrame, stocks: DataFrame, indexes: DataFrame, phase: int) -> DataFrame:
    """The rows of the phase's tokens, with every panel column: an index lacks most of them."""
    panels = {INDUSTRY: index_as_panel(indexes, stocks.columns), STOCK: stocks}
    parts = [panels[kind] for kind in PHASES[phase]]
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return whole.join(tokens.select("code"), "code", "left_semi")


def asset_scores(
    panel: DataFrame, tokens: DataFrame, industry: DataFrame, mentions: DataFrame,
    sources: tuple[FeatureSource, ...] = ALL_SOURCES,
) -> DataFrame:
    """(code, token_type, trade_date, features): z-scores of all tokens, each asset class apart."""
    flagged = attach_mentions(attach_forward_adjusted(panel), industry, mentions)
    feats = compute_features(flagged, sources).join(tokens.select("code", "token_type"), "code")
    columns = tuple(c for s in sources for c in s.columns)
    return zscore_by_day(feats, columns, keys=("token_type", "trade_date"))


def phase_cube(
    phase: int, stocks: DataFrame, indexes: DataFrame, industry: DataFrame, mentions: DataFrame, universe: DataFrame | None = None,
) -> DataFrame:
    """A row per token and day of the phase's own calendar: day_idx, the token's columns, close, traded and the
    features, which are 0 where the token has no row; in phase 3 open, high, low and ``label`` too.

    Only rows of the phase's tokens are read from ``stocks`` and ``indexes``, so their date range is the
    cube's.
    """
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}")
    tokens = token_index(industry, universe, phase)
    panel = phase_panel(tokens, stocks, indexes, phase)
    calendar = trading_calendar(panel)
    prices = panel.select("code", "trade_date", *(PRICES if phase == 3 else ("close",)))
    grid = dense_grid(prices, tokens, calendar)
    grid = with_hit_labels(grid, calendar) if phase == 3 else grid
    z = asset_scores(panel, tokens, industry, mentions).drop("token_type")
    cube = grid.join(z, ["code", "trade_date"], "left").join(tokens, "code")
    extra = ["open", "high", "low", "label"] if phase == 3 else []
    return cube.select(
        "trade_date", "day_idx", "token_idx", "code", "token_type", "industry_id", "close", F.col("close").isNotNull().alias("traded"),
        *extra, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES],
    )


def cube_blocks(cube: DataFrame, columns: tuple[str, ...] = FEATURES, tokens_per_block: int = 256, real: str = "float") -> DataFrame:
    """A row per (day, run of ``tokens_per_block`` tokens) with array columns in the order of token_idx:
    every other column of the cube, and ``features``, an array of ``columns`` per token. The arrays' length is bounded by
    the block, whatever the number of tokens."""
    per_token = [c for c in cube.columns if c not in ("trade_date", "day_idx", *columns)]
    item = F.struct(*per_token, F.array(*[F.col(c).cast(real) for c in columns]).alias("features"))
    rows = cube.groupBy("trade_date", "day_idx", F.floor(F.col("token_idx") / tokens_per_block).cast("int").alias("block")).agg(
        F.array_sort(F.collect_list(item), lambda a, b: a["token_idx"] - b["token_idx"]).alias("items"))
    return rows.select("trade_date", "day_idx", "block", *[F.col(f"items.{c}").alias(c) for c in (*per_token, "features")])


def cube_rows(blocks: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """A row per token and day again."""
    arrays = [c for c in blocks.columns if c not in ("trade_date", "day_idx", "block")]
    rows = blocks.select("trade_date", "day_idx", F.explode(F.arrays_zip(*arrays)).alias("t"))
    one = [F.element_at("t.features", k + 1).cast("double").alias(c) for k, c in enumerate(columns)]
    return rows.select("trade_date", "day_idx", *[F.col(f"t.{c}").alias(c) for c in arrays if c != "features"], *one)


def write_cube(blocks: DataFrame, path: str) -> None:
    """Stored by day; days that are written again replace their old blocks."""
    blocks.repartition("trade_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path)


def read_cube(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """The blocks of an inclusive range; other days' folders are not opened."""
    from tapeloom.operators.calendar import inclusive

    return inclusive(spark.read.parquet(path), start, end)
