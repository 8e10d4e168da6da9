"""Row-clock windows: lags, rolling aggregates with a minimum count, EWM.

A panel has one row per (code, trade_date), so the rows of one code never outnumber the
dates of the calendar (some ten thousand). That primary key, enforced by
``sources.tables.upsert``, is what bounds every window partitioned by code, however large
the raw input of one code is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def _window_calls(text: str) -> list[str]:
    """The ``fn(args) over (spec)`` parts of an expression, found by matching parentheses."""
    out, at = [], text.find(") over (")
    while at >= 0:
        depth, start = 0, at
        while True:
            depth += {")": 1, "(": -1}.get(text[start], 0)
            if depth == 0:
                break
            start -= 1
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        depth, end = 1, at + len(") over (")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out.append(text[start:end])
        at = text.find(") over (", end)
    return out


def _shared_windows(columns: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Window calls used more than once get a column of their own: Spark evaluates every
    occurrence of a window call separately."""
    calls = [c for e in columns.values() for c in _window_calls(e)]
    shared = {c: f"_h{i}" for i, c in enumerate(dict.fromkeys(c for c in calls if calls.count(c) > 1))}
    for call, name in shared.items():
        columns = {n: e.replace(call, name) for n, e in columns.items()}
    return {name: call for call, name in shared.items()}, columns


def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add SQL-text columns; text keeps plan building cheap for the many expressions of a
    feature set, and repeated window calls are computed once."""
    return pick(df, df.columns, columns)


def pick(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """The key columns and the SQL-text columns."""
    shared, columns = _shared_windows(columns)
    if shared:
        df = df.selectExpr("*", *[f"{call} as {name}" for name, call in shared.items()])
    return df.selectExpr(*keys, *[f"{e} as {n}" for n, e in columns.items()])


def at_least(x: str, low: float) -> str:
    """Lower clamp that keeps NULL (``greatest`` would replace it)."""
    return f"case when {x} < {low} then {low}D else {x} end"


def block_clock(df: DataFrame) -> Clock:
    """The clock whose sort the frame already has: by kept EWM blocks, else by date."""
    kept = [c for c in df.columns if c.startswith("_blk")]
    return Clock(order=f"{kept[0].replace('_blk', '_sup')}, {kept[0]}, _rn") if kept else Clock()


class Clock:
    """Row-clock expressions over one partition and order, so all of them share a sort."""

    def __init__(self, keys: str = "code", order: str = "trade_date"):
        self.spec = f"partition by {keys} order by {order}"

    def over(self, frame: str = "") -> str:
        return f"over ({self.spec} {frame})"

    def trailing(self, n: int) -> str:
        return self.over(f"rows between {n - 1} preceding and current row")

    @property
    def so_far(self) -> str:
        return self.over("rows between unbounded preceding and current row")

    @property
    def before(self) -> str:
        return self.over("rows between unbounded preceding and 1 preceding")

    @property
    def whole(self) -> str:
        return self.over("rows between unbounded preceding and unbounded following")

    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) {self.over()}"

    def rn(self) -> str:
        return f"row_number() {self.over()}"

    def roll(self, fn: str, x: str, n: int, min_rows: int | None = None) -> str:
        """``fn`` over the last n rows; NULL until ``min_rows`` (default n) values exist."""
        need = n if min_rows is None else min_rows
        value = f"{fn}({x}) {self.trailing(n)}"
        return value if need <= 1 else f"(case when count({x}) {self.trailing(n)} >= {need} then {value} end)"

    def mean(self, x, n, min_rows=None) -> str:
        return self.roll("avg", x, n, min_rows)

    def std(self, x, n, min_rows=None) -> str:
        return self.roll("stddev_pop", x, n, min_rows)

    def total(self, x, n, min_rows=None) -> str:
        return self.roll("sum", x, n, min_rows)

    def max(self, x, n, min_rows=None) -> str:
        return self.roll("max", x, n, min_rows)

    def min(self, x, n, min_rows=None) -> str:
        return self.roll("min", x, n, min_rows)

    def corr(self, x: str, y: str, n: int, min_rows: int | None = None) -> str:
        """Pearson correlation over complete pairs; a constant side gives NULL, not an error."""
        both = f"{x} is not null and {y} is not null"
        px, py = f"case when {both} then {x} end", f"case when {both} then {y} end"
        w = self.trailing(n)
        need = n if min_rows is None else min_rows
        return (
            f"case when count({px}) {w} >= {need} then try_divide(covar_pop({px}, {py}) {w}, "
            f"stddev_pop({px}) {w} * stddev_pop({py}) {w}) end"
        )

    def streak(self, flag: str, rn: str) -> str:
        """Length of the run of true flags ending at this row (``rn`` is the row number)."""
        return f"{rn} - coalesce(max(case when not {flag} then {rn} end) {self.so_far}, 0)"

    def rows_since(self, flag: str, rn: str, cap: int) -> str:
        """Rows since the flag was last true; ``cap`` when never or longer ago."""
        return f"least(coalesce({rn} - max(case when {flag} then {rn} end) {self.so_far}, {cap}), {cap})"


#: Short blocks of rows in a long one.
BLOCKS = 256


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def _block_rows(alphas: list[float]) -> int:
    """Block length at which the smallest in-block weight stays far inside double range."""
    strongest = max(alphas)
    if strongest >= 1.0:
        return 1
    return max(1, min(256, int(460.0 / -math.log1p(-strongest))))


def with_ewm(
    df: DataFrame,
    series: dict[str, tuple[str, float]],
    keys: tuple[str, ...] = ("code",),
    order: str = "trade_date",
    keep: bool = False,
) -> DataFrame:
    """Add exponentially weighted means, ``{new column: (input column, alpha)}``.

    Semantics: y starts at the first value; a later value x after g missing rows gives
    y = (w*y + alpha*x) / (w + alpha) with w = (1-alpha)^(g+1); a missing row repeats y.

    y is an affine function of the previous y, so runs of rows compose. Rows are cut into short blocks
    and 256 blocks into a long one. Inside a short block the recursion is a running sum of values
    divided by the running weight product (which cannot underflow there). A short block's map is told
    by its last row; folding those of the blocks before it in its long block gives the row's map since the long
    block began, and folding the last such map of each long block gives the value carried into it. So a row
    folds at most 256 maps and one for each 256 blocks before: time is linear up to many million rows
    of one key. Every step is a window over the same partition and sort, evaluated in the JVM. With ``keep``
    the row number and blocks stay in the frame; later calls and windows then reuse the sort.
    """
    if not series:
        return df
    names, have = ", ".join(keys), list(df.columns)
    size = _block_rows([a for _, a in series.values()])
    blk, sup = f"_blk{size}", f"_sup{size}"
    if "_rn" not in have:
        df = add(df, {"_rn": Clock(names, order).rn()})
    if blk not in have:
        df = add(df, {blk: f"cast((_rn - 1) div {size} as int)", sup: f"cast((_rn - 1) div {size * BLOCKS} as int)"})
    t = Clock(names, f"{sup}, {blk}, _rn")
    inside = Clock(f"{names}, {sup}", f"{blk}, _rn")
    block = Clock(f"{names}, {sup}, {blk}", "_rn").so_far

    seen = {f"_p{i}": f"max(case when {src} is not null then _rn end) {t.before}"
            for i, (src, _) in enumerate(series.values())}
    df = add(df, seen)
    step = {}
    # the weight after a very long gap is held above zero, far below what shows, so that a block's product is too
    for i, (src, alpha) in enumerate(series.values()):
        w = f"power({1.0 - alpha!r}D, _rn - _p{i})"
        step[f"_d{i}"] = f"case when {src} is null or _p{i} is null then 1.0D else greatest({w} / ({w} + {alpha!r}D), 1e-87D) end"
        step[f"_g{i}"] = (
            f"case when {src} is null then 0.0D when _p{i} is null then double({src}) "
            f"else {src} * {alpha!r}D / ({w} + {alpha!r}D) end"
        )
    df = add(df, step)
    df = add(df, {f"_w{i}": f"exp(sum(ln(_d{i})) {block})" for i in range(len(series))})
    df = add(df, {f"_l{i}": f"_w{i} * sum(_g{i} / _w{i}) {block}" for i in range(len(series))})
    n = range(len(series))

    def closing(w: str, map_: str) -> str:
        return "named_struct(" + ", ".join(f"'w{i}', {w}{i}, 'l{i}', {map_}{i}" for i in n) + ")"

    df = add(df, {"_ends": f"collect_list(case when _rn % {size} = 0 then {closing('_w', '_l')} end) {inside.before}"})
    unit = "named_struct('w', 1.0D, 'l', 0.0D)"
    df = add(df, {f"_m{i}": f"aggregate(_ends, {unit}, (m, e) -> named_struct('w', e.w{i} * m.w, 'l', e.w{i} * m.l + e.l{i}))" for i in n})
    df = add(df, {f"_u{i}": f"_w{i} * _m{i}.w" for i in n} | {f"_v{i}": f"_w{i} * _m{i}.l + _l{i}" for i in n})
    df = add(df, {"_tops": f"collect_list(case when _rn % {size * BLOCKS} = 0 then {closing('_u', '_v')} end) {t.before}"})
    out = {}
    for i, (name, (src, _)) in enumerate(series.items()):
        carry = f"aggregate(_tops, 0.0D, (y, e) -> e.w{i} * y + e.l{i})"
        out[name] = f"case when _p{i} is not null or {src} is not null then _u{i} * {carry} + _v{i} end"
    if keep:
        have += [c for c in ("_rn", sup, blk) if c not in have]
    return pick(df, have, out)
