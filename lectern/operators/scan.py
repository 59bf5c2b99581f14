"""Running totals that do not put a whole group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _same(names: list[str]) -> Column:
    """Null-safe equality of the named columns of sides ``r`` and ``o``."""
    return reduce(lambda a, b: a & b, [F.col(f"r.{n}").eqNullSafe(F.col(f"o.{n}")) for n in names])


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, out: str, block: int = 4096) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the group's rows up to and including this one, by an integer ``order``.

    The order axis is cut into blocks. Only one row per block goes through the per-group window (a group of a
    billion rows is a window of some 250,000), and each block's own window holds at most ``block`` order values.
    """
    b = F.floor(F.col(order) / block).alias("_block")
    rows = df.withColumn("_value", value).withColumn("_block", b)
    per_block = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    joined = rows.alias("r").join(offsets.alias("o"), _same([*keys, "_block"])).select("r.*", "o._offset")
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (joined.withColumn(out, F.col("_offset") + F.sum("_value").over(inside))
            .drop("_value", "_block", "_offset"))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, block: int = 4096) -> DataFrame:
    """Exact median of a whole-numbered column per group: ``keys`` and ``out`` (double); nulls don't count.

    Rows shrink to counts by value before anything is moved. A running total over the values, block by block, tells which
    values hold the middle ranks; no buffer holds a group's values.
    """
    counts = (df.select(*keys, F.col(value).cast("bigint").alias("_v")).filter("_v is not null")
              .groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    upto = running_total(counts, keys, "_v", F.col("_c"), "_upto", block)
    both = upto.alias("r").join(n.alias("o"), _same(keys) if keys else F.lit(True)).select("r.*", "o._n")  # without keys: one row
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)
    middle = both.filter(holds(low) | holds(high))  # one or two rows a group
    return middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(out))


def previous_value(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add ``out`` = ``value`` of the group's previous row by an integer ``order`` (``lag``), block by block.

    Inside a block it is a plain lag; a block's first row looks up the last row of the nearest earlier block.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    last = rows.groupBy(*keys, "_block").agg(F.max_by(F.struct(value), F.col(order)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block")
    carried = last.select(*keys, "_block", F.lag("_last").over(before).alias("_carry"))
    joined = rows.alias("r").join(carried.alias("o"), _same([*keys, "_block"])).select("r.*", "o._carry")
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    first = F.row_number().over(inside) == 1
    return (joined.withColumn(out, F.when(first, F.col("_carry")[value]).otherwise(F.lag(value).over(inside)))
            .drop("_block", "_carry"))


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out`` = 1-based position of each row in a total order, without sorting everything in one task.

    Rows are range-partitioned and sorted; a row's position is its place in its partition plus the sizes of the
    partitions before it. The sorted rows are checkpointed, so both steps see the same partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id()
    rows = df.orderBy(*order).withColumn("_m", place).checkpoint()
    rows = rows.withColumn("_part", F.shiftright("_m", 33)).withColumn(
        "_row", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    # one row per partition of the sort
    return (rows.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_row") + 1)
            .drop("_m", "_part", "_row", "_before"))
