"""Structured Streaming jobs: landing-folder ingest, file events, job progress, live trends, replay-safe feeds.

Functions take a streaming (or static) DataFrame and return one, except the ``run_*`` helpers that start a query.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import catalog, chunking
from ..operators.scan import running_total
from ..operators.usage import COUNTED
from ..session import ensure_checkpoint_dir
from ..sources import files as files_source
from ..sources import snapshots

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- file events ------------------------------------------------------------------------------------------------------

def classify_file_events(events: DataFrame) -> DataFrame:
    """What to do about each file-system event: rows of (ts, action, path).

    ``events``: ts, kind (created, modified, closed, deleted, moved), path, dest_path, is_dir, dest_is_dir. A vanished
    path without a readable extension counts as a folder. Actions: folder_gone, scan_tree, touch (readable files only).
    """
    supported = files_source.is_supported(F.col("path"))
    kind = F.col("kind")
    folder = (F.coalesce("is_dir", F.lit(False)) | ((kind == "deleted") & ~supported)
              | ((kind == "moved") & F.coalesce("dest_is_dir", F.lit(False))))

    def todo(cond, action: str, path: str):
        return F.when(cond, F.struct(F.lit(action).alias("action"), F.col(path).alias("path")))

    acts = F.array(
        todo(folder & kind.isin("deleted", "moved"), "folder_gone", "path"),
        todo(folder & (kind == "moved"), "scan_tree", "dest_path"),
        todo(folder & (kind == "created"), "scan_tree", "path"),
        todo(~folder & kind.isin("created", "modified", "closed", "deleted", "moved") & supported, "touch", "path"),
        todo(~folder & (kind == "moved") & files_source.is_supported(F.col("dest_path")), "touch", "dest_path"))
    return events.select("ts", F.inline(F.filter(acts, lambda a: a.isNotNull())))


def settled(events: DataFrame, key: str = "path", quiet: str = "2 seconds", lateness: str = "10 seconds",
            kind: str = "kind") -> DataFrame:
    """One row per burst of events on a key, once it has been quiet: key, last_kind, last_ts, n.

    A burst is a session window: it ends where no event follows for the quiet time, and is emitted when the watermark
    passes that end. A late event within the lateness bound may join two bursts. State is one row per open burst.
    """
    seconds = events.sparkSession.range(1).select(F.expr(f"cast(interval {quiet} as interval second)").alias("g")).first()["g"]
    gap = seconds // timedelta(microseconds=1) - 1  # sessions that touch are one, bursts a whole quiet time apart are not
    rest = events.withWatermark("ts", lateness).select(key, "ts", F.col(kind).alias("kind"))
    return rest.groupBy(key, F.session_window("ts", f"{gap} microseconds").alias("_w")).agg(
        F.max_by("kind", "ts").alias("last_kind"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("_w")


# --- job events and the question log ----------------------------------------------------------------------------------

def live_counts(events: DataFrame, key: str = "job") -> DataFrame:
    """Running counts per job and counted action (update or complete mode)."""
    counted = events.filter((F.col("type") == "file") & F.col("action").isin(COUNTED))
    return counted.groupBy(key, "action").agg(F.count("*").alias("n"))


def live_daily(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Questions per UTC day and latency, emitted once the day can no longer change: day, latency_ms, n.

    State is one row per open day and value. :func:`daily_trend` makes days of what was emitted.
    """
    g = log.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "latency_ms").agg(F.count("*").alias("n"))
    utc = F.to_utc_timestamp("w.start", F.current_timezone())
    return g.select(F.to_date(utc).alias("day"), "latency_ms", "n")


def daily_trend(counts: DataFrame) -> DataFrame:
    """Questions and exact (lower) median latency per day, from the counts of :func:`live_daily`; nulls have no latency."""
    total = counts.groupBy("day").agg(F.sum("n").alias("questions"), F.sum(F.when(F.col("latency_ms").isNotNull(), F.col("n"))).alias("_timed"))
    upto = running_total(counts.filter("latency_ms is not null"), ["day"], "latency_ms", F.col("n"), "_upto")
    middle = upto.join(total, "day").filter((2 * F.col("_upto") >= F.col("_timed")) & (2 * (F.col("_upto") - F.col("n")) < F.col("_timed")))
    return total.join(middle.select("day", F.col("latency_ms").alias("median_ms")), "day", "left").select("day", "questions", "median_ms")


def replay_dedup(items: DataFrame, key: str, lateness: str = "1 day") -> DataFrame:
    """First copy of each item; copies that arrive within the lateness bound are dropped."""
    return items.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def last_events(events: DataFrame, key: str = "job", order: str = "seq", keep: int = 200) -> DataFrame:
    """The newest ``keep`` events of each job, held as state; emits a job's list whenever it changes (update mode).

    Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    fields = [f for f in events.schema.fields if f.name != key]
    schema = T.StructType(fields)
    names = [f.name for f in fields]

    class Newest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.rows = handle.getListState("rows", schema)

        def handleInputRows(self, group_key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            kept = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
            for pdf in rows:  # never more than the kept rows and one batch in memory
                kept += list(pdf[names].itertuples(index=False, name=None))
                kept = sorted(kept, key=lambda r: r[names.index(order)])[-keep:]
            self.rows.put(kept)
            out = pd.DataFrame(kept, columns=names)
            out.insert(0, key, group_key[0])
            yield out

        def close(self) -> None:
            pass

    return events.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Newest(), outputStructType=T.StructType([events.schema[key], *fields]),
        outputMode="Update", timeMode="None")


# --- running ----------------------------------------------------------------------------------------------------------

def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all data available now and return what was emitted, with the micro-batch number as ``_batch``.

    Output goes to Parquet folders, one per micro-batch and overwritten on a retry, never through the driver.
    """
    spark = df.sparkSession
    base = scratch_folder(spark, name)
    schema = T.StructType([*df.schema.fields, T.StructField("_batch", T.LongType())])

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(
            f"{base}/out/part-{number}")

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # every shuffle partition is a state store; beyond twice the cores they only add overhead
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.shuffle.partitions": str(min(partitions, 2 * spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = (df.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True)
                 .option("checkpointLocation", f"{base}/checkpoint").start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


DOC_SCHEMA = ("path string, course string, title string, mime string, size bigint, mtime timestamp, sha256 string, status string, "
              "parser_version int, first_seen timestamp, ingested_at timestamp")
CHUNK_SCHEMA = "path string, chunks array<struct<page:int,ord:int,text:string,n_tokens:bigint>>"


class Library:
    """The documents and chunks that a continuous ingest keeps: two keyed tables below ``base``."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64):
        self.documents = snapshots.KeyedTable(spark, f"{base}/documents", DOC_SCHEMA, "path", buckets)
        self.by_path = snapshots.KeyedTable(spark, f"{base}/chunks", CHUNK_SCHEMA, "path", buckets)

    def chunks(self) -> DataFrame:
        """path, page, ord, text, n_tokens of all current documents."""
        return self.by_path.read().select("path", F.inline("chunks"))

    def compact(self) -> None:
        self.documents.compact()
        self.by_path.compact()


def sync_listing(listing: DataFrame, library: Library, number: int, contents: Callable[[DataFrame], DataFrame],
                 excluded: DataFrame | None = None, version: int = catalog.PARSER_VERSION, max_tokens: int = 500,
                 overlap: int = 80) -> None:
    """Bring the library to what a listing of the landing folder (path, size, mtime) says.

    A path is read, through ``contents(paths) -> (path, text)``, if it is new or its size or time changed; it is ingested
    if its content, status or parser version did. Ingesting replaces the document (``first_seen`` stays) and all of its
    chunks. Paths that are no longer listed, or excluded, go with their chunks: a deleted or moved folder is no more than
    its paths. Listing ``number`` again, after a lost run, writes the same batch again.
    """
    spark = listing.sparkSession
    known = library.documents.read().checkpoint()
    excluded = spark.createDataFrame([], "path string") if excluded is None else excluded
    listed = files_source.path_rules(listing.select("path", "size", "mtime")).filter("supported")
    before = known.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("parser_version").alias("_version"))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")) & (F.col("_version") == version)
    touched = (listed.join(excluded.select("path").distinct(), "path", "left_anti").join(before, "path", "left")
               .filter(~F.coalesce(same, F.lit(False))).drop("_size", "_mtime", "_version").checkpoint())
    read = touched.join(contents(touched.select("path")), "path").withColumn("text", X.normalize(F.col("text")))
    planned = catalog.plan_ingest(read.withColumn("sha256", F.sha2("text", 256)), known, excluded, version)
    first = known.select("path", F.col("first_seen").alias("_first"))
    planned = planned.join(first, "path", "left").withColumn("title", files_source.note_title(F.col("text"), F.col("path"))).checkpoint()
    due = planned.filter("result = 'ingest'").withColumn("page", F.lit(1))
    status = chunking.text_status(due.select(F.col("path").alias("doc_id"), "text", "mime")).select(
        F.col("doc_id").alias("path"), F.col("status").alias("_status"))
    old = known.select("path", F.col("status").alias("_old"))
    rows = planned.join(status, "path", "left").join(old, "path", "left").select(
        "path", "course", "title", "mime", "size", "mtime", "sha256", F.coalesce("_status", "_old").alias("status"),
        F.lit(version).alias("parser_version"), F.coalesce("_first", F.current_timestamp()).alias("first_seen"),
        F.current_timestamp().alias("ingested_at"))
    kept = listed.join(excluded.select("path").distinct(), "path", "left_anti").select("path")
    gone = known.select("path").join(kept, "path", "left_anti").checkpoint()
    pieces = chunking.chunk_lists(due, max_tokens, overlap, keys=("path", "page"))
    # one row per document, without a shuffle; its chunks are bounded by its own text
    listed_chunks = F.transform("chunks", lambda c: F.struct(F.col("page").alias("page"), c["ord"].alias("ord"), c["text"].alias("text"),
                                                             c["n_tokens"].cast("bigint").alias("n_tokens")))
    by_path = pieces.select("path", F.when(F.size("chunks") > 0, listed_chunks).alias("chunks"))
    # chunks first: a crash in between leaves documents unmarked, so the retry does the same work again
    library.by_path.write(number, by_path, gone)
    library.documents.write(number, rows, gone)


def list_landing(spark: SparkSession, landing: str) -> DataFrame:
    """path (below ``landing``), size and mtime of every file there, by Spark's own file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing)
    return files.select(files_source._relative(F.col("path"), landing).alias("path"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("mtime"))


def landing_texts(spark: SparkSession, landing: str, per_read: int = 1000) -> Callable[[DataFrame], DataFrame]:
    """Reader of the texts of listed paths, some files at a time, so that only paths in hand are at the driver."""

    def read(paths: DataFrame) -> DataFrame:
        out = spark.createDataFrame([], "path string, text string")
        held: list[str] = []

        def more() -> DataFrame:
            escaped = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in held]  # names may hold signs that readers expand
            raw = spark.read.text([f"{landing.rstrip('/')}/{p}" for p in escaped], wholetext=True)
            uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            return out.unionByName(raw.select(files_source._relative(uri, landing).alias("path"), F.col("value").alias("text")))

        for row in paths.toLocalIterator():
            held.append(row["path"])
            if len(held) == per_read:
                out, held = more(), []
        return more() if held else out

    return read


def publish_listing(listing: DataFrame, folder: str, number: int) -> None:
    """Store a listing below ``folder`` and, once it is whole, its marker: the event that the ingest stream waits for."""
    listing.write.mode("overwrite").parquet(f"{folder}/listings/{number}")
    marker = listing.sparkSession.createDataFrame([(number, f"{folder}/listings/{number}")], "number bigint, listing string")
    marker.coalesce(1).write.mode("append").json(f"{folder}/markers")


def run_ingest(spark: SparkSession, folder: str, library: Library, checkpoint: str, contents: Callable[[DataFrame], DataFrame],
               excluded: Callable[[], DataFrame] | None = None, once: bool = False):
    """Follow the listings published below ``folder`` and keep the library up to date. Returns the query.

    Offsets are listings: each micro-batch is one of them, compared with the library by joins, so that edits, deletions,
    moved folders and exclusions are seen, not only new files. ``excluded()`` is asked at every batch.
    """
    markers = (spark.readStream.schema("number bigint, listing string").option("maxFilesPerTrigger", 1).json(f"{folder}/markers"))

    def step(batch: DataFrame, _: int) -> None:
        for row in sorted(batch.collect()):  # the markers of a batch: one small row a listing
            sync_listing(spark.read.parquet(row["listing"]), library, row["number"], contents, excluded() if excluded else None)

    writer = markers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()
