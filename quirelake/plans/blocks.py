"""Ordered computations over groups of any size, none of which is sorted whole in one task.

A group (a page, a document) may hold a large share of all rows, so a plain window over
it would run in a single task. Every function here cuts a group into blocks of consecutive
positions first: block totals are pre-aggregated map-side, chained in a small window over the
*blocks*, and joined back to a window that only ever sees one block. ``order`` is an integer
column that is unique within a group, so a block holds at most ``2 ** bits`` rows. Callers that know their groups to be
small pass ``bits=None``: a plain window, without a shuffle of its own where whole groups lie together already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16
_BLOCK = "__block"
_CARRY = "__carry"
_VALUE = "__value"


def _block(order: str, bits: int) -> Column:
    return F.shiftright(F.col(order).cast("long"), bits)


def _join_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on group and block; null-safe so that null keys keep their rows."""
    right = carry.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col(_BLOCK).alias("__r_block"), _CARRY)
    cond = F.col(_BLOCK) == F.col("__r_block")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(right, cond, "left").drop("__r_block", *[f"__r_{k}" for k in keys])


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, bits: int | None = BLOCK_BITS
) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` within each group."""
    if bits is None:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value.cast("long")).over(whole))
    df = df.withColumn(_VALUE, value.cast("long")).withColumn(_BLOCK, _block(order, bits))
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, _BLOCK)
        .agg(F.sum(_VALUE).alias("__total"))
        .withColumn(_CARRY, F.coalesce(F.sum("__total").over(before), F.lit(0)))
    )
    within = Window.partitionBy(*keys, _BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(out, F.sum(_VALUE).over(within))
    return (
        _join_carry(local, carry, keys)
        .withColumn(out, F.col(out) + F.coalesce(F.col(_CARRY), F.lit(0)))
        .drop(_VALUE, _BLOCK, _CARRY)
    )


def dense_position(
    df: DataFrame, keys: list[str], order: str, out: str, bits: int | None = BLOCK_BITS
) -> DataFrame:
    """0-based rank of each row in ``order`` within its group."""
    ranked = running_sum(df, keys, order, F.lit(1), "__rank", bits)
    return ranked.withColumn(out, (F.col("__rank") - 1)).drop("__rank")


def next_marked(
    df: DataFrame, keys: list[str], order: str, mark: Column, out: str, bits: int | None = BLOCK_BITS
) -> DataFrame:
    """``order`` of the next marked row at or after each row of its group; null if there is none."""
    if bits is None:
        whole = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(F.when(mark, F.col(order).cast("long")), ignorenulls=True).over(whole))
    df = df.withColumn(_VALUE, F.when(mark, F.col(order).cast("long"))).withColumn(_BLOCK, _block(order, bits))
    later = Window.partitionBy(*keys).orderBy(F.desc(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, _BLOCK)
        .agg(F.min(_VALUE).alias("__first"))
        .withColumn(_CARRY, F.last("__first", ignorenulls=True).over(later))
    )
    # Descending, so that the frame only grows: the last value seen is the nearest one ahead.
    within = (
        Window.partitionBy(*keys, _BLOCK).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = df.withColumn(out, F.last(_VALUE, ignorenulls=True).over(within))
    return (
        _join_carry(local, carry, keys)
        .withColumn(out, F.coalesce(F.col(out), F.col(_CARRY)))
        .drop(_VALUE, _BLOCK, _CARRY)
    )
