"""Quarter-end arithmetic and quarter labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shift_quarter(c: Column | str, quarters: int) -> Column:
    """Quarter end ``quarters`` after (or before) a quarter end."""
    return F.last_day(F.add_months(_col(c), 3 * quarters))


def quarter_distance(start: Column | str, end: Column | str) -> Column:
    start, end = _col(start), _col(end)
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.floor(months / 3).cast("int")


def quarter_end_of_label(label: str) -> str:
    """Last day of a quarter written ``2024q1``, as ISO text."""
    match = re.fullmatch(r"(\d{4})q([1-4])", label.strip().lower())
    if not match:
        raise ValueError(f"not a quarter label: {label!r}")
    year, quarter = int(match[1]), int(match[2])
    return f"{year}-{quarter * 3:02d}-{31 if quarter in (1, 4) else 30}"


def quarter_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Inclusive range of labels, one row per quarter: (quarter, quarter_end)."""
    first, last = quarter_end_of_label(start), quarter_end_of_label(end)
    if first > last:
        raise ValueError("the first quarter is after the last one")
    ends = F.explode(
        F.expr(
            f"transform(sequence(trunc(date'{first}','MM'), trunc(date'{last}','MM'),"
            " interval 3 month), d -> last_day(d))"
        )
    )
    return spark.range(1).select(ends.alias("quarter_end")).select(
        quarter_label("quarter_end").alias("quarter"), "quarter_end"
    )


def quarter_label(c: Column | str) -> Column:
    return F.format_string("%dq%d", F.year(_col(c)), F.quarter(_col(c)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
