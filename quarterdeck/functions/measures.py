"""Numeric expressions of the holdings domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Filings before this day report thousands of dollars.
UNIT_CHANGE_DATE = "2023-01-03"
ACTION_TOLERANCE = 1e-8
EMA_ALPHA = 0.6


def to_dollars(value: Column | str, filing_date: Column | str, cutover: str = UNIT_CHANGE_DATE) -> Column:
    early = _col(filing_date) < F.lit(cutover).cast("date")
    return F.when(early, _col(value) * F.lit(1000).cast("long")).otherwise(_col(value))


def percent_change(old: Column | str, new: Column | str) -> Column:
    """Relative change as double, null when the old value is 0."""
    old, new = _col(old).cast("double"), _col(new).cast("double")
    return F.try_divide(new - old, old)


def share_of(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(_col(part).cast("double"), _col(whole).cast("double")), F.lit(0.0))


def position_action(current: Column | str, target: Column | str, tolerance: float = ACTION_TOLERANCE) -> Column:
    """new / exit / increase / decrease / unchanged between two weights."""
    now, then, eps = _col(current), _col(target), F.lit(tolerance)
    held, will_hold = now > eps, then > eps
    return (
        F.when(~held & will_hold, "new")
        .when(held & ~will_hold, "exit")
        .when(then - now > eps, "increase")
        .when(now - then > eps, "decrease")
        .otherwise("unchanged")
    )


def normalised_ema(weights: Sequence[Column | str], alpha: float = EMA_ALPHA) -> Column:
    """Exponentially weighted mean of a short history, newest first."""
    factors = [alpha * (1 - alpha) ** age for age in range(len(weights))]
    total = sum(factors)
    terms = [F.coalesce(_col(w), F.lit(0.0)) * F.lit(f) for w, f in zip(weights, factors)]
    summed = terms[0]
    for term in terms[1:]:
        summed = summed + term
    return summed / F.lit(total)


def finite_or_zero(c: Column | str) -> Column:
    value = _col(c).cast("double")
    return F.when(F.abs(value) < float("inf"), value).otherwise(0.0)  # NaN is greater than infinity, null is not less


def fixed(value: Column | str, digits: int) -> Column:
    """Text with that many decimals, halves to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def cosine(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Cosine of two short feature vectors; 0 when either norm is 0."""
    def dot(a, b):
        products = [x.cast("double") * y.cast("double") for x, y in zip(a, b)]
        out = products[0]
        for p in products[1:]:
            out = out + p
        return out

    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.coalesce(F.try_divide(dot(left, right), norms), F.lit(0.0))


def octave(c: Column | str) -> Column:
    """Power-of-two magnitude of a non-negative number, -2000 for 0 and less.

    Monotone in its argument, so it can split a descending order into bands.
    """
    value = _col(c).cast("double")
    return F.when(value > 0, F.floor(F.log2(value)).cast("int")).otherwise(F.lit(-2000))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
