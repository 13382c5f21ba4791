"""Null, zero and order rules that every operator shares.

Group keys drop nulls; conditions treat null as false; 0/0 and x/0 are null and take an explicit
default; "first" means the first non-null value by an explicit order; a rolling value needs its whole
frame before the current row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str, default: float | None = None) -> Column:
    """``a / b`` as double, ``default`` where that is undefined or null."""
    out = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities in float columns become null, so that sorts and joins see one kind of missing."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in df.columns if kinds[c] in ("double", "float")})


def first_non_null(c: str, order: str) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))


def rolling(f, c: str, n: int, by: WindowSpec) -> Column:
    """``f`` over the ``n`` rows before this one, null unless all are there."""
    frame = by.rowsBetween(-n, -1)
    return F.when(F.count(c).over(frame) == n, f(c).over(frame))


def batting_team(topbot: str = "inning_topbot") -> Column:
    return F.when(F.col(topbot) == "Bot", F.col("home_team")).otherwise(F.col("away_team"))


def fielding_team(topbot: str = "inning_topbot") -> Column:
    return F.when(F.col(topbot) == "Top", F.col("home_team")).otherwise(F.col("away_team"))


def opposing_team(topbot: str = "inning_topbot") -> Column:
    return F.when(F.col(topbot) == "Top", F.col("away_team")).otherwise(F.col("home_team"))


def decimal_odds(american: Column | str) -> Column:
    """Payout with the stake of American odds; zero and null give null."""
    o = col(american).cast("double")
    return F.when(o > 0, o / 100 + 1).when(o < 0, F.lit(100.0) / F.abs(o) + 1)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by a rational polynomial for erf, off by less than 1e-7."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF[0]) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF[1:]):
        poly = (poly + F.lit(a)) * t
    half = F.lit(0.5) * poly * F.exp(-x * x)
    return F.when(z >= 0, F.lit(1.0) - half).otherwise(half)


# Abramowitz and Stegun 7.1.26 (p, then a1 to a5).
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def exact_normal_cdf(z: Column) -> Column:
    """The same to the last digits: a series for the error function near zero, and a continued fraction
    for its complement beyond, so that small tails keep their digits too."""
    x = F.abs(z) / F.lit(2.0**0.5)
    s = z * z / F.lit(2.0)  # not from x, whose rounding would grow in the exponent
    series, fraction = F.lit(1.0), x
    for k in range(SERIES, 0, -1):
        series = F.lit(1.0) + series * s * F.lit(2.0 / (2 * k + 1))
    for k in range(FRACTION, 0, -1):
        fraction = x + F.lit(k / 2) / fraction
    near = F.lit(0.5) - x * F.exp(-s) * series / F.lit(math.pi**0.5)
    half = F.when(x < NEAR, near).otherwise(F.exp(-s) / fraction / F.lit(2 * math.pi**0.5))
    return F.when(z >= 0, F.lit(1.0) - half).otherwise(half)


#: Terms of the series up to ``NEAR`` and of the fraction from there on leave less than a double shows.
NEAR, SERIES, FRACTION = 1.5, 30, 80


def soften(p: Column | str, factor: float = 0.85) -> Column:
    return (col(p) - 0.5) * factor + 0.5


def staked_ev(p: Column | str, payout: Column | str, strict: bool = False) -> Column:
    """Expected value of one unit. Payouts include the stake, so the strict form takes off the whole
    stake; the other one takes off only what a loss costs."""
    win = col(p) * col(payout)
    return win - 1 if strict else win - (F.lit(1.0) - col(p))
