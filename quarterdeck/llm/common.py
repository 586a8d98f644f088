"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_code  # noqa: F401  (the operators take it from here)

#: largest table, in bytes, that an operator hands to every executor
BROADCAST_BYTES = 24 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df`` marked for broadcast if its measured rows stay below :data:`BROADCAST_BYTES`, else as it is.

    ``df`` should be a saved stage, as its rows are counted. Where rows hold texts or lists, ``row_bytes`` is
    a column with the bytes of a row, and their sum is measured.
    """
    total = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def set_aside(df: DataFrame, *named: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``named`` under names that no operator uses, and what selects the columns as they were."""
    names = {c: c if c in named else f"carried_{k}" for k, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()]), [F.col(name).alias(c) for c, name in names.items()]


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of columns of the same names."""
    out = F.lit(True)
    for name in names:
        out = out & a[name].eqNullSafe(b[name])
    return out
