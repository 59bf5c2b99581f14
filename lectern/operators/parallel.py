"""Two size checks used before choosing a physical shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition rows by a unique key when the input has fewer splits than there are cores.

    Heavy per-row text work on a file with one split would otherwise run on one core. A large table has plenty of
    splits and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast only after measuring that it has at most ``max_rows`` rows of ``BROADCAST_BYTES`` in all.

    Strings, binaries and arrays count by their length, other columns eight bytes. Beyond that the join is left to
    Spark: sort-merge, with hot keys split at run time.
    """
    sizes = []
    for field in df.schema:
        kind = field.dataType.typeName()
        col = F.col(f"`{field.name}`")
        sizes.append(F.octet_length(col) if kind in ("string", "binary")
                     else F.octet_length(F.to_json(col)) if kind in ("array", "map", "struct") else F.lit(8))
    row = sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(16))
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(row)).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= BROADCAST_BYTES else df
