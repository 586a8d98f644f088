"""Ranks inside groups that may be too large for one task.

A plain ``row_number`` window sends each group to one task. Here the caller names
*bands*: columns that split the group's order into consecutive pieces (a power of
two of the value, a day, ...). Rows are ranked inside (group, band), and a small
histogram of band sizes gives each band its starting position, so a group that
holds a third of the data is still spread over its bands. The histogram also
carries group totals, so weights need no second pass over the rows.

Keys and bands travel as one struct, whose equality takes nulls for values: the window and the
join to the histogram then share one partitioning and one sort of the rows.

The input is read twice; hand in a saved stage, not a long lazy plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


#: rows of a group that one task sorts; larger groups are cut into bands
WHOLE_ROWS = 1 << 22


def rank_whole(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank", totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The columns of :func:`rank_within` by plain windows, for groups of at most ``WHOLE_ROWS`` rows.

    Rows that are dealt by some of the keys stay where they are, so the input may be a lazy plan.
    """
    group = Window.partitionBy(*keys)
    placed = df.withColumn(name, F.row_number().over(group.orderBy(*order)).cast("long"))
    return placed.withColumns({k: F.sum(c).over(group) for k, c in (totals or {}).items()})


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bands: Sequence[Column],
    name: str = "rank",
    totals: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its group.

    ``bands`` must be non-decreasing along ``order``. ``totals`` maps new column
    names to sums over the whole group, ``running`` to sums up to and including the row.
    """
    band_names = [f"__band{i}" for i in range(len(bands))]
    banded = df.withColumns(dict(zip(band_names, bands)))
    cells = [*keys, *band_names]
    totals, running = dict(totals or {}), dict(running or {})

    sizes = banded.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__sum_{k}") for k, c in (totals | running).items()]
    )
    along = Window.partitionBy(*keys).orderBy(*band_names)
    whole = Window.partitionBy(*keys)
    starts = sizes.select(
        F.struct(*cells).alias("__of"),
        (F.sum("__n").over(along) - F.col("__n")).alias("__start"),
        *[F.sum(f"__sum_{k}").over(whole).alias(k) for k in totals],
        *[(F.sum(f"__sum_{k}").over(along) - F.col(f"__sum_{k}")).alias(f"__start_{k}") for k in running],
    )
    banded = banded.withColumn("__cell", F.struct(*cells)).drop(*band_names)
    cell = Window.partitionBy("__cell").orderBy(*order)
    so_far = cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = banded.withColumns({
        "__pos": F.row_number().over(cell).cast("long"), **{f"__run_{k}": F.sum(c).over(so_far) for k, c in running.items()},
    })
    return placed.join(starts, F.col("__cell") == F.col("__of")).select(
        *df.columns, (F.col("__start") + F.col("__pos")).alias(name), *totals,
        *[(F.col(f"__start_{k}") + F.col(f"__run_{k}")).alias(k) for k in running],
    )
