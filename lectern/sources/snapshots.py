"""Keyed upserts on plain Parquet, as joins over whole tables or as a change log by key bucket; backups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert_documents(current: DataFrame, incoming: DataFrame, key: str = "path",
                     keep: tuple[str, ...] = ("id", "first_seen")) -> DataFrame:
    """Insert or replace by key. ``keep`` columns are taken from the current row when there is one."""
    c, i = current.alias("c"), incoming.alias("i")
    joined = c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    arrived = F.col(f"i.{key}").isNotNull()

    def pick(name: str) -> Column:
        if name == key:
            return F.coalesce(f"i.{key}", f"c.{key}").alias(key)
        if name in keep:
            return F.coalesce(f"c.{name}", f"i.{name}").alias(name)
        return F.when(arrived, F.col(f"i.{name}")).otherwise(F.col(f"c.{name}")).alias(name)

    return joined.select(*[pick(n) for n in current.columns])


def replace_children(children: DataFrame, new: DataFrame, parents: DataFrame, key: str = "doc_id") -> DataFrame:
    """All children of the given parents are replaced by the new ones; the other parents keep theirs.

    A task holds its share of the parents' keys, each once, and children stream past them; sorting them would hold a task's
    share of all their columns.
    """
    kept = children.join(parents.select(key).hint("shuffle_hash"), key, "left_anti")
    return kept.select(*children.columns).unionByName(new.select(*children.columns))


def delete_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    names = [on] if isinstance(on, str) else on
    return df.join(keys.select(*names).distinct(), names, "left_anti")


def restore_missing(existing: DataFrame, backup: DataFrame, pk: str, parent: DataFrame | None = None,
                    parent_key: str | None = None, child_key: str | None = None) -> DataFrame:
    """Backup rows to insert: primary key not present yet, and (if given) parent present. Nothing is overwritten; of
    several backup rows of one key the least by its JSON text is taken."""
    one = backup.groupBy(pk).agg(F.min_by(F.struct(*backup.columns), F.to_json(F.struct(*backup.columns))).alias("_r"))
    rows = one.select("_r.*").join(existing.select(pk), pk, "left_anti")
    if parent is not None:
        p = parent.select(F.col(parent_key).alias("_parent")).distinct()
        child = F.col(child_key or parent_key)
        rows = (rows.filter(child.isNotNull()).join(p, child == F.col("_parent"), "left_semi")
                .unionByName(rows.filter(child.isNull())))
    return rows.select(*existing.columns)


def export_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Tagged JSON lines ``{"table": .., "row": {..}}`` of several tables, ready for ``write.text``."""
    parts = [df.select(F.to_json(F.struct(F.lit(name).alias("table"), F.struct("*").alias("row"))).alias("value"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def write_backup(tables: dict[str, DataFrame], folder: str) -> None:
    export_tables(tables).write.mode("errorifexists").text(folder, compression="gzip")


def backup_counts(lines: DataFrame, names: list[str]) -> DataFrame:
    """Rows per table in a backup, zero for tables it does not contain."""
    counted = lines.groupBy(F.get_json_object("value", "$.table").alias("table")).count()
    dim = lines.sparkSession.createDataFrame([(n,) for n in names], "table string")
    return (dim.join(counted, "table", "left")
            .select("table", F.coalesce("count", F.lit(0)).cast("bigint").alias("n")))


def read_backup(lines: DataFrame, table: str, schema) -> DataFrame:
    """Typed rows of one table of a backup."""
    mine = lines.filter(F.get_json_object("value", "$.table") == table)
    return mine.select(F.from_json(F.get_json_object("value", "$.row"), schema).alias("r")).select("r.*")


def expired(manifest: DataFrame, n: int, name: str = "name") -> DataFrame:
    """Snapshots to delete when only the newest ``n`` (at least 1, names sort by time) are kept."""
    kept = manifest.select(name).orderBy(F.desc(name)).limit(max(1, n))
    return manifest.join(kept, name, "left_anti")


class KeyedTable:
    """A table with one current row per key, kept as a change log in Parquet and read as it now stands.

    ``log`` holds every change, partitioned by a hash bucket of the key and by batch; a batch is written with Spark's
    dynamic partition overwrite, so a retried batch replaces what it wrote before and nothing else. ``main`` holds, per
    bucket, the newest row of each key up to the last compaction, deletions included; compacting rewrites only buckets
    with newer changes. Reading takes the newest row per key of both. A key's rows share a bucket, hence a task group.
    Few buckets do not mean few tasks: Spark rebalances what is written, so that a large bucket is several files.
    """

    def __init__(self, spark: SparkSession, base: str, schema: str | T.StructType, key: str, buckets: int = 64):
        fields = T.StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
        self.spark, self.base, self.key, self.buckets = spark, base.rstrip("/"), key, buckets
        self.names = [f.name for f in fields]
        self.schema = T.StructType([*fields, T.StructField("_deleted", T.BooleanType()), T.StructField("_upto", T.LongType()),
                                    T.StructField("_bucket", T.IntegerType()), T.StructField("_batch", T.LongType())])
        empty = spark.createDataFrame([], self.schema)
        empty.write.mode("ignore").partitionBy("_bucket", "_batch").parquet(f"{self.base}/log")
        empty.write.mode("ignore").partitionBy("_bucket").parquet(f"{self.base}/main")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/{name}").select(self.schema.names)

    def _changes(self) -> DataFrame:
        """Rows of ``main``, and of the log what is newer than its bucket's last compaction."""
        main = self._table("main")
        upto = main.groupBy("_bucket").agg(F.max("_upto").alias("_merged"))  # at most one row a bucket
        newer = (self._table("log").join(F.broadcast(upto), "_bucket", "left")
                 .filter(F.col("_batch") > F.coalesce("_merged", F.lit(-1))).select(self.schema.names))
        return main.unionByName(newer)

    def _newest(self, rows: DataFrame) -> DataFrame:
        row = F.struct(*self.schema.names)
        return rows.groupBy("_bucket", self.key).agg(F.max_by(row, "_batch").alias("_r")).select("_r.*")

    def write(self, number: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Batch ``number``: new rows (one per key) and the keys that are gone. Running it again changes nothing."""
        changes = rows.select(*self.names, F.lit(False).alias("_deleted"))
        if gone is not None:
            nothing = [F.lit(None).cast(self.schema[n].dataType).alias(n) for n in self.names if n != self.key]
            changes = changes.unionByName(gone.select(self.key, *nothing, F.lit(True).alias("_deleted")))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        (changes.withColumns({"_upto": F.lit(None).cast("bigint"), "_bucket": bucket, "_batch": F.lit(number).cast("bigint")})
         .hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_bucket", "_batch").parquet(f"{self.base}/log"))

    def read(self) -> DataFrame:
        """The current rows."""
        return self._newest(self._changes()).filter(~F.col("_deleted")).select(*self.names)

    def compact(self) -> None:
        """Fold the log into ``main``, bucket by bucket; only buckets with newer changes are rewritten."""
        rows = self._changes()
        due = rows.groupBy("_bucket").agg(F.max("_batch").alias("_last"), F.max(F.coalesce("_upto", F.lit(-1))).alias("_merged"))
        due = due.filter("_last > _merged").select("_bucket", "_last")  # at most one row a bucket
        merged = self._newest(rows.join(F.broadcast(due), "_bucket", "left_semi")).join(F.broadcast(due), "_bucket")
        (merged.withColumn("_upto", F.col("_last")).select(self.schema.names).hint("rebalance", "_bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.base}/main"))
