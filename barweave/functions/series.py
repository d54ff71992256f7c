"""Rolling and recursive series as native window expressions.

All functions assume one row per (symbol, ts) and a zero-based row index ``i``: every
frame shares one window specification, so stacking them adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def by_time():
    return Window.partitionBy("symbol").orderBy("ts")


def whole():
    return by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def running():
    return by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_rows(n: int):
    return by_time().rowsBetween(-(n - 1), Window.currentRow)


def lag(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(by_time())


def lead(x: str, n: int = 1) -> Column:
    return F.lead(x, n).over(by_time())


def full(value: Column, x: Column, n: int) -> Column:
    """``value`` only where the last ``n`` rows hold n non-null ``x``."""
    return F.when(F.count(x).over(last_rows(n)) == n, value)


def mean(x: Column, n: int, partial: bool = False) -> Column:
    m = F.avg(x).over(last_rows(n))
    return m if partial else full(m, x, n)


def deviation(x: Column, n: int) -> Column:
    return full(F.stddev_samp(x).over(last_rows(n)), x, n)


# rows up to which the powers of the closed form stay far inside double range
CLOSED_FORM_ROWS = 1000
# weight below which an older row no longer changes a double
NEGLIGIBLE = 1e-20

Terms = dict[str, tuple[Column, float]]


def linear(df: DataFrame, terms: Terms, rows: int) -> DataFrame:
    """Adds v_t = d v_(t-1) + u_t, from v = 0, for every term name -> (u, d); NULL inputs count as 0.

    Up to ``CLOSED_FORM_ROWS`` rows per symbol the sum of u_t d^-t is taken at once. Beyond
    them the powers overflow, so the recurrence is scanned by doubling: after k steps a row
    holds the terms of its last 2^k rows, and a step is one ``lag`` over the same windows.
    Doubling ends when older rows weigh less than ``NEGLIGIBLE``.
    """
    if rows <= CLOSED_FORM_ROWS:
        i = F.col("i")
        return df.withColumns(
            {n: F.sum(F.coalesce(u, F.lit(0.0)) * F.pow(F.lit(d), -i)).over(running()) * F.pow(F.lit(d), i) for n, (u, d) in terms.items()}
        )
    df = df.withColumns({n: F.coalesce(u, F.lit(0.0)).cast("double") for n, (u, _) in terms.items()})
    step = 1
    while open_terms := {n: d**step for n, (_, d) in terms.items() if d**step >= NEGLIGIBLE}:
        df = df.withColumns({n: F.col(n) + weight * F.coalesce(lag(n, step), F.lit(0.0)) for n, weight in open_terms.items()})
        step *= 2
    return df


def ema(x: Column, n: int, first: Column | None = None) -> tuple[Column, float]:
    """Term of the exponential mean seeded with the first value, alpha = 2 / (n + 1)."""
    a = 2.0 / (n + 1)
    return F.when(F.col("i") == 0 if first is None else first, x).otherwise(a * x), 1 - a


def adjusted_ema(name: str, x: Column, alpha: float) -> tuple[Terms, Column]:
    """Terms and value of the exponential mean with normalised weights; NULL rows carry no weight."""
    up, down = f"_{name}_sum", f"_{name}_weight"
    terms = {up: (x, 1 - alpha), down: (F.when(x.isNotNull(), 1.0), 1 - alpha)}
    return terms, F.when(F.count(x).over(running()) > 0, F.try_divide(F.col(up), F.col(down)))


def seeded_ema(x: Column, alpha: float, start: int, seed: Column) -> tuple[Column, float]:
    """Term of the recursion ``v += alpha (x - v)`` from row ``start``, where it equals ``seed``; valid from there on."""
    i = F.col("i")
    return F.when(i == start, seed).when(i > start, alpha * x), 1 - alpha


def from_row(name: str, start: int) -> Column:
    return F.when(F.col("i") >= start, F.col(name))
