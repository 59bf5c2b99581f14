"""Registered queries: streaming jobs over the events table, compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import feeds as S
from .registry import query
from .usage_plans import SYNC_SQL, sync_events

#: Slices of the events, one a micro-batch; rows of a file of a slice about.
SLICES, FILE_ROWS = 4, 250_000


class Live:
    """The tables of ``Tables`` with ``events`` as a stream of some slices, one a micro-batch, in order of time.

    Every twentieth event comes up to half an hour late, often in the slice after its own. With ``closing`` a last slice
    holds one event of no user, so late that the watermark passes all others: the end of the input.

    However large the table, it is read once a slice, and a key meets at most so many micro-batches. Slices are equal
    shares of the events, each of the same number of files, which is what a micro-batch takes.
    """

    def __init__(self, t, closing: bool = False):
        folder = S.scratch_folder(t.spark, "events")
        e = t.events
        files = max(1, -(-e.count() // (SLICES * FILE_ROWS)))
        late = F.when(F.pmod(F.xxhash64("event_id"), F.lit(20)) == 0, 1800).otherwise(0)
        # events of one second lie apart by a fraction of their own, so no cut meets many
        second = F.unix_timestamp(F.col("ts").cast("timestamp")) + late + F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(1 << 20)) / (1 << 20)
        cuts = e.agg(F.percentile_approx(second, [i / SLICES for i in range(1, SLICES)], 1000).alias("c")).first()["c"] or []
        place = sum(((second >= c).cast("int") for c in sorted(set(cuts))), F.lit(0))
        spread = F.pmod(F.xxhash64("event_id", F.lit(2)), F.lit(files))
        for i in range(len(set(cuts)) + 1):
            (e.filter(place == i).withColumn("_file", spread).repartition(files, "_file")
             .write.mode("append").partitionBy("_file").parquet(folder))
        if closing:
            end = {"ts": F.max("ts") + F.expr("interval 400 days"), **{c: F.lit(None).cast(e.schema[c].dataType) for c in e.columns if c != "ts"}}
            e.agg(*(v.alias(c) for c, v in end.items())).select(e.columns).coalesce(1).write.mode("append").parquet(folder)
        self.events: DataFrame = (t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files)
                                  .option("recursiveFileLookup", "true").parquet(folder))


def batches(out: DataFrame) -> DataFrame:
    """What a stream returned; it must have taken more than one micro-batch to do so."""
    assert out.agg(F.count_distinct("_batch")).first()[0] > 1
    return out


def stamped(t):
    """Event times are UTC, whatever the session's zone. ``t``: the tables, or their live form."""
    return t.events.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp"))


FILE_SQL = """fe AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'created' WHEN 'view' THEN 'modified' WHEN 'signup' THEN 'moved' WHEN 'error' THEN 'deleted' ELSE 'opened' END AS kind,
  'a/' || user_id || CASE WHEN k < 60 THEN '.PDF' WHEN k < 80 THEN '' ELSE '.exe' END AS path, CASE WHEN k < 30 THEN 'b/~$' || user_id || '.md' ELSE 'b/' || user_id || '.md' END AS dest_path, k >= 95 AS is_dir, k >= 90 AS dest_is_dir
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)),
 fc AS (SELECT *, is_dir OR (kind = 'deleted' AND path NOT LIKE '%.PDF') OR (kind = 'moved' AND dest_is_dir) AS folder FROM fe)"""


@query("s3_classify_file_events", f"""WITH {FILE_SQL}, r AS (
 SELECT 'folder_gone' AS action, path FROM fc WHERE folder AND kind IN ('deleted', 'moved') UNION ALL SELECT 'scan_tree', dest_path FROM fc WHERE folder AND kind = 'moved'
 UNION ALL SELECT 'scan_tree', path FROM fc WHERE folder AND kind = 'created' UNION ALL SELECT 'touch', path FROM fc WHERE NOT folder AND kind <> 'opened' AND path LIKE '%.PDF'
 UNION ALL SELECT 'touch', dest_path FROM fc WHERE NOT folder AND kind = 'moved' AND dest_path NOT LIKE '%~$%')
SELECT action, path, count(*) AS n FROM r GROUP BY 1, 2""")
def s3(t):
    k, user = F.get_json_object("props", "$.k").cast("int"), F.col("user_id").cast("string")
    kind = F.col("event_type")
    e = stamped(Live(t)).select(
        "ts", F.when(kind == "click", "created").when(kind == "view", "modified").when(kind == "signup", "moved")
        .when(kind == "error", "deleted").otherwise("opened").alias("kind"),
        F.concat(F.lit("a/"), user, F.when(k < 60, ".PDF").when(k < 80, "").otherwise(".exe")).alias("path"),
        F.concat(F.when(k < 30, "b/~$").otherwise("b/"), user, F.lit(".md")).alias("dest_path"),
        (k >= 95).alias("is_dir"), (k >= 90).alias("dest_is_dir"))
    out = batches(S.run_available(S.classify_file_events(e), "classify"))
    return out.groupBy("action", "path").agg(F.count("*").alias("n"))


@query("s2_settled", """
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
 b AS (SELECT user_id, sid, arg_max(event_type, ts) AS last_kind, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, last_kind, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, n FROM b""")
def s2(t):
    """Two quiet hours settle a user's burst of events; the end of the input settles the rest."""
    events = stamped(Live(t, closing=True))
    out = batches(S.run_available(S.settled(events, "user_id", "2 hours", "1 hour", "event_type"), "settled"))
    return out.filter("user_id is not null").select("user_id", "last_kind", F.date_format(
        F.to_utc_timestamp("last_ts", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "n")


@query("s4_live_counts", f"""WITH {SYNC_SQL}
SELECT job, CASE event_type WHEN 'click' THEN 'downloaded' WHEN 'view' THEN 'saved_page' WHEN 'purchase' THEN 'already_had' ELSE 'failed' END AS action, count(*) AS n
FROM ev WHERE type = 'file' GROUP BY 1, 2""")
def s4(t):
    out = batches(S.run_available(S.live_counts(sync_events(Live(t))), "counts", "update"))
    return out.groupBy("job", "action").agg(F.max_by("n", "_batch").alias("n"))


@query("s5_live_daily", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS questions, quantile_disc(CAST(floor(value * 1000) AS BIGINT), 0.5) AS median_ms FROM events GROUP BY 1""")
def s5(t):
    """Days as the watermark closes them; the end of the input closes the last ones."""
    log = stamped(Live(t, closing=True)).withColumn("latency_ms", F.floor(F.col("value") * 1000))
    out = S.daily_trend(batches(S.run_available(S.live_daily(log), "daily")).drop("_batch"))
    return out.select(F.col("day").cast("string").alias("day"), "questions", "median_ms")


@query("s6_replay_dedup", "SELECT event_id, user_id FROM events")
def s6(t):
    """Every event is delivered twice."""
    twice = stamped(Live(t)).select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return batches(S.run_available(S.replay_dedup(twice, "event_id"), "dedup")).select("event_id", "user_id")


@query("s7_last_events", """
SELECT user_id AS job, event_id AS seq, event_type AS type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""")
def s7(t):
    e = Live(t).events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"),
                              F.col("event_type").alias("type"))
    out = batches(S.run_available(S.last_events(e, keep=20), "last", "update"))
    newest = out.groupBy("job").agg(F.max("_batch").alias("_batch"))
    return out.join(newest, ["job", "_batch"]).select("job", "seq", "type")


@query("s1_ingest_listings", """
WITH d AS (SELECT *, 'in/' || source || '/' || doc_id || '.md' AS path,
  CASE WHEN doc_id % 10 = 3 THEN 'edited ' || coalesce(text, '') ELSE coalesce(text, '') END AS final FROM documents),
 l AS (SELECT CASE WHEN source = (SELECT min(source) FROM documents) THEN 'in/moved/' || doc_id || '.md' ELSE path END AS path, final
  FROM d WHERE doc_id % 10 <> 1 AND doc_id % 10 <> 2)
SELECT path, octet_length(encode(final)) AS size FROM l""")
def s1(t):
    """Three listings of a folder made of all documents: first all of them; then a tenth is edited and a tenth deleted;
    then the first source's folder is moved and a tenth excluded. Each is a micro-batch; the library as it stands at the
    end, with chunks for every document that has text."""
    folder = S.scratch_folder(t.spark, "ingest")
    first = t.documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    path = F.concat(F.lit("in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    tenth = F.pmod("doc_id", F.lit(10))
    edited = F.when(tenth == 3, F.concat(F.lit("edited "), "text")).otherwise(F.col("text"))
    first_source = t.documents.agg(F.min("source").alias("s"))
    moved = F.when(F.col("source") == F.col("s"), F.concat(F.lit("in/moved/"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(path)
    states = [first.select(path.alias("path"), "text"),
              first.filter(tenth != 1).select(path.alias("path"), edited.alias("text")),
              first.filter(tenth != 1).crossJoin(F.broadcast(first_source)).select(moved.alias("path"), edited.alias("text"))]  # one row
    for number, state in enumerate(states):
        state.write.parquet(f"{folder}/contents/number={number}")
        listing = state.select("path", F.octet_length("text").cast("bigint").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("mtime"))
        S.publish_listing(listing, folder, number)
    seen: list[int] = []

    def contents(paths):
        seen.append(len(seen))
        now = t.spark.read.parquet(f"{folder}/contents/number={seen[-1]}")
        return now.join(paths, "path", "left_semi")

    out = first.filter(tenth == 2).select(path.alias("path"))
    out = out.unionByName(first.filter(tenth == 2).select(F.concat(F.lit("in/moved/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")))
    library = S.Library(t.spark, f"{folder}/library", 8)
    S.run_ingest(t.spark, folder, library, f"{folder}/checkpoint", contents, lambda: out if len(seen) == 2 else None, once=True).awaitTermination()
    assert len(seen) == len(states)
    library.compact()
    documents = library.documents.read()
    chunked = library.by_path.read().filter(F.size("chunks") > 0).select("path", F.lit(True).alias("chunked"))
    whole = documents.join(chunked, "path", "left").filter((F.col("status") != "ok") | F.coalesce("chunked", F.lit(False)))
    return whole.select("path", F.col("size").cast("bigint").alias("size"))
