"""Ordered scans over the rows of a key, without one task per key.

Most rules look at the previous or next paragraph that has some property, or
count paragraphs so far. A window over ``PARTITION BY doc_id`` answers that but
pulls all rows of one manuscript into one task. ``scan`` cuts every key into
blocks of consecutive positions, runs the windows per (key, block), reduces
each block to one summary row, carries the summaries across blocks, and joins
them back. A key of any size is spread over as many tasks as it has blocks.

Blocks of a dense order (paragraph numbers) are ranges of the order itself. Where
the order is sparse (ids, hashes) or crowded (many rows in one place), ``ranged``
takes the blocks from the data: the rows are range-partitioned by key and order
and written once, so their block is the partition that they were written from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.session import stage

BLOCK_ROWS = 32768
_BLOCK_CONF = "galley.scan.blockRows"


@dataclass(frozen=True)
class Step:
    """What to carry: ``near`` (closest non-null), ``sum``, ``max`` or ``min``."""

    kind: str
    value: Column
    forward: bool = False
    inclusive: bool = False


def prev(value: Column) -> Step:
    """Last non-null value strictly before the row."""
    return Step("near", value)


def last(value: Column) -> Step:
    """Last non-null value at or before the row."""
    return Step("near", value, inclusive=True)


def following(value: Column) -> Step:
    """First non-null value strictly after the row."""
    return Step("near", value, forward=True)


def running_sum(value: Column, inclusive: bool = True) -> Step:
    return Step("sum", value, inclusive=inclusive)


def running_max(value: Column, inclusive: bool = True) -> Step:
    return Step("max", value, inclusive=inclusive)


def remaining_min(value: Column) -> Step:
    """Smallest value strictly after the row."""
    return Step("min", value, forward=True)


def block_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(_BLOCK_CONF, str(BLOCK_ROWS)))


def scan(df: DataFrame, keys: list[str], order: list[str], ranged: bool = False, **steps: Step) -> DataFrame:
    """Add one column per step to ``df``.

    Keys must not be null; ``order[0]`` must be a whole number unless ``ranged``.
    """
    values = [step.value.alias(f"_v_{name}") for name, step in steps.items()]
    if ranged:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = df.select("*", *values).repartitionByRange(parts, *keys, *order)
        carried = stage(rows.withColumn("_block", F.spark_partition_id().cast("long")), "scan")
    else:
        block = F.floor(F.col(order[0]) / F.lit(block_rows(df))).cast("long").alias("_block")
        carried = df.select("*", block, *values)
    block_keys = [*keys, "_block"]
    ascending = Window.partitionBy(*block_keys).orderBy(*[F.col(c).asc() for c in order])
    descending = Window.partitionBy(*block_keys).orderBy(*[F.col(c).desc() for c in order])

    local = carried.select(
        *carried.columns,
        *[_local(step, name, ascending, descending) for name, step in steps.items()],
    )

    position = F.struct(*[F.col(c) for c in order])
    summary = carried.groupBy(*block_keys).agg(
        *[_summary(step, name, position) for name, step in steps.items()]
    )
    over_blocks = Window.partitionBy(*keys)
    back = over_blocks.orderBy(F.col("_block").asc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = over_blocks.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in block_keys],
        *[
            _across(step, F.col(f"_s_{name}"), ahead if step.forward else back).alias(f"_c_{name}")
            for name, step in steps.items()
        ],
    )
    on = None
    for key in block_keys:
        same = F.col(key) == F.col(f"_k_{key}")
        on = same if on is None else on & same
    return local.join(carry, on, "left").select(
        *df.columns,
        *[
            _combine(step, F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name)
            for name, step in steps.items()
        ],
    )


def _local(step: Step, name: str, ascending, descending) -> Column:
    window = (descending if step.forward else ascending).rowsBetween(
        Window.unboundedPreceding, 0 if step.inclusive else -1
    )
    return _across(step, F.col(f"_v_{name}"), window).alias(f"_l_{name}")


def _across(step: Step, value: Column, window) -> Column:
    if step.kind == "near":
        return F.last(value, ignorenulls=True).over(window)
    return getattr(F, step.kind)(value).over(window)


def _summary(step: Step, name: str, position: Column) -> Column:
    value = F.col(f"_v_{name}")
    if step.kind == "near":
        pick = F.min_by if step.forward else F.max_by
        return pick(value, F.when(value.isNotNull(), position)).alias(f"_s_{name}")
    return getattr(F, step.kind)(value).alias(f"_s_{name}")


def _combine(step: Step, local: Column, carried: Column) -> Column:
    if step.kind == "near":
        return F.coalesce(local, carried)
    if step.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return F.greatest(local, carried) if step.kind == "max" else F.least(local, carried)
