"""Joins on ranges of an ordered column, in slices of it, so that no task gets all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(ts: Column) -> Column:
    """Seconds of a time stamp since 1970, fractions included; numbers stay as they are."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def _slice(df: DataFrame, column: str, width: float) -> Column:
    number = F.col(f"`{column}`").cast("double") if dict(df.dtypes)[column] in ("int", "bigint", "smallint", "tinyint", "float", "double") else _seconds(F.col(f"`{column}`"))
    return F.floor(number / F.lit(float(width)))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, before: float, how: str = "inner") -> DataFrame:
    """Rows of ``left`` with those of ``right`` of equal ``keys`` whose ``ts`` lies up to ``before`` seconds (or units) before
    their own, or at it; columns of ``right`` are prefixed by ``r_``. Null keys and times meet nothing.

    Both sides are dealt to slices of ``before``: a row meets its own slice and the one before it, whatever the number of
    rows of its key.
    """
    slices = _slice(left, ts, before)
    l_side = left.withColumn("__slice", F.explode_outer(F.array(slices, slices - 1)))
    r_side = right.select([F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns] + [_slice(right, ts, before).alias("r___slice")])
    gap = lambda a, b: F.col(f"`{a}`").cast("double") - F.col(f"`{b}`").cast("double") if dict(left.dtypes)[a] in ("int", "bigint", "double", "float") else _seconds(F.col(f"`{a}`")) - _seconds(F.col(f"`{b}`"))
    same = [F.col(f"`{k}`") == F.col(f"`r_{k}`") for k in keys] + [F.col("__slice") == F.col("r___slice"), gap(ts, f"r_{ts}").between(0, before)]
    if how != "inner":
        raise ValueError("a row would be unmatched in one slice and matched in the other: join what is missing by key")
    return l_side.join(r_side, same).drop("__slice", "r___slice")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], width: float = 86_400.0) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` of equal ``keys`` at or before its ``ts``, or nulls.

    Of right rows of one time, the one of the greatest ``values`` holds. Rows meet within slices of ``width`` seconds (or
    units); what a slice begins with is carried over from the last row of each earlier one, a row per key and slice.
    """
    found = F.struct(F.col(f"`{ts}`").alias("ts"), *[F.col(f"`{v}`").alias(v) for v in values])
    r_side = right.select(*[f"`{k}`" for k in keys], F.col(f"`{ts}`").alias("__ts"), found.alias("__found"), _slice(right, ts, width).alias("__slice")).filter(F.col("__ts").isNotNull())
    l_side = left.withColumns({"__ts": F.col(f"`{ts}`"), "__slice": _slice(left, ts, width)})
    last = r_side.groupBy(*keys, "__slice").agg(F.max("__found").alias("__last"))
    every = last.unionByName(l_side.select(*keys, "__slice").distinct(), allowMissingColumns=True).groupBy(*keys, "__slice").agg(F.max("__last").alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "__slice", F.max("__last").over(earlier).alias("__carried"))
    both = l_side.withColumn("__left", F.lit(True)).unionByName(r_side.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "__slice").orderBy("__ts", "__left").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("__here", F.max("__found").over(so_far)).filter("__left")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__of_{k}`")) for k in keys] + [F.col("__slice").eqNullSafe(F.col("__of_slice"))]
    carried = carried.select(*[F.col(f"`{k}`").alias(f"__of_{k}") for k in keys], F.col("__slice").alias("__of_slice"), "__carried")
    whole = F.when(F.array_min(F.array(*[F.col(f"`{k}`").isNotNull() for k in keys], F.col("__ts").isNotNull())), F.coalesce("__here", "__carried"))
    return met.join(carried, same, "left").withColumn("__found", whole).select([f"`{c}`" for c in left.columns] + [F.col(f"__found.{v}").alias(f"r_{v}") for v in values])
