"""Order-dependent helpers that do not need a whole key in one task.

A tenant's log, or one busy case, may hold a large share of all rows. A window over the key alone
would put all of them into one task. Here an ordered key is cut into ranges of its order column,
neighbours are found inside each range, and only one row per range is exchanged to join the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_WIDTH = 1 << 20


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    alias: str,
    *,
    following: bool = False,
    width: int = RANGE_WIDTH,
) -> DataFrame:
    """Add ``alias`` = ``value`` of the row before (or after) in ``order`` within ``keys``.

    ``order`` is a unique integer per key. The result is null for the first (last) row of a key.
    """
    cut = "__range"
    parts = [*keys, cut]
    ranged = df.withColumn(cut, F.floor(F.col(order) / F.lit(width))).withColumn(
        "__value", F.struct(value.alias("v"))
    )
    step, pick = (F.lead, F.min_by) if following else (F.lag, F.max_by)
    # One row per range: the value that enters it from the range before (after) it.
    seeds = (
        ranged.groupBy(*parts)
        .agg(pick("__value", order).alias("__value"))
        .withColumn("__value", step("__value").over(Window.partitionBy(*keys).orderBy(cut)))
        .filter(F.col("__value").isNotNull())
        .withColumn("__seed", F.lit(True))
    )
    # The seeds stand in front of their range's rows, so the rows are exchanged once and never joined.
    seeded = ranged.withColumn("__seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    onward = F.desc_nulls_first(order) if following else F.asc_nulls_first(order)
    near = F.lag("__value").over(Window.partitionBy(*parts).orderBy(onward))
    return seeded.withColumn(alias, near["v"]).filter(~F.col("__seed")).drop(cut, "__value", "__seed")


def latest_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Newest row per key by the given ascending order columns.

    An aggregate, not a window: every task reduces its rows to one per key before the shuffle.
    """
    columns = [c for c in (columns or df.columns) if c not in keys]
    row = F.struct(*columns).alias("__row")
    rank = F.struct(*order)
    best = df.groupBy(*keys).agg(F.max_by(row, rank).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in columns])


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark cuts every map task to ``n`` per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")
