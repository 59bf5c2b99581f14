"""The question log as a history: search, paging, labels, grouping by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def local_time(ts: Column, tz: str) -> Column:
    """Wall-clock time in a named zone of a UTC time stamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def history(log: DataFrame, course: str | None = None, q: str | None = None, before: int | None = None,
            limit: int | None = 50) -> DataFrame:
    """Newest first; literal text in question or answer; ``before`` is the last id of the previous page.

    ``limit`` rows, or all of them with None. With a limit the plan is a filtered scan and a top-k, never a full sort.
    """
    if course:
        log = log.filter(F.col("course") == course)
    if q:
        log = log.filter(X.icontains(F.col("question"), q) | X.icontains(F.col("answer"), q))
    if before is not None:
        log = log.filter(F.col("id") < before)
    newest = log.orderBy(F.desc("id"))
    return newest if limit is None else newest.limit(max(1, limit))


def page_after(df: DataFrame, key: str, last, n: int) -> DataFrame:
    """Keyset paging, ascending: the ``n`` rows after key value ``last``."""
    return df.filter(F.col(key) > F.lit(last)).orderBy(key).limit(n)


def merge_labels(current: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply label edits to ``id, feedback, relevant``.

    ``edits``: ``id, seq, set_feedback, feedback, relevant``. Feedback changes only where ``set_feedback``; a mark of
    NULL clears that citation, others are set, marks not mentioned stay. An empty map becomes NULL.
    """
    marks = (edits.select("id", "seq", F.explode("relevant").alias("n", "v"))
             .groupBy("id", "n").agg(F.max(F.struct("seq", "v"))["v"].alias("v"))
             .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("n", "v"))).alias("_marks")))
    rated = (edits.filter("set_feedback").groupBy("id")
             .agg(F.max(F.struct("seq", "feedback"))["feedback"].alias("_f"), F.lit(True).alias("_set")))
    empty = F.create_map().cast("map<string,boolean>")
    j = current.join(marks, "id", "left").join(rated, "id", "left")
    new = F.coalesce("_marks", empty)
    kept = F.map_filter(F.coalesce("relevant", empty), lambda k, v: ~F.map_contains_key(new, k))
    merged = F.map_filter(F.map_concat(kept, new), lambda k, v: v.isNotNull())
    others = [c for c in current.columns if c not in ("id", "feedback", "relevant")]
    return j.select("id", F.when(F.col("_set"), F.col("_f")).otherwise(F.col("feedback")).alias("feedback"),
                    F.when(F.size(merged) > 0, merged).alias("relevant"), *others)


def history_by_day(log: DataFrame, tz: str = "UTC") -> DataFrame:
    """Per local day: number of entries, and the newest and oldest of them."""
    day = F.to_date(local_time(F.col("ts"), tz))
    return log.groupBy(day.alias("day")).agg(
        F.count("*").alias("entries"), F.max_by("id", F.struct("ts", "id")).alias("newest_id"),
        F.min_by("id", F.struct("ts", "id")).alias("oldest_id"))


def day_groups(page: DataFrame, tz: str = "UTC") -> DataFrame:
    """One history page as groups: day and its entry ids, newest first."""
    day = F.to_date(local_time(F.col("ts"), tz))
    ids = F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("ts", "id")))), lambda s: s["id"])
    return page.groupBy(day.alias("day")).agg(ids.alias("ids"))


def entry_status(log: DataFrame) -> DataFrame:
    """Shape shown for a log row: ``error`` without an answer, start = end - latency, marks never NULL."""
    ms = F.coalesce("latency_ms", F.lit(0))
    start = F.expr("ts") - F.make_dt_interval(secs=ms / 1000)
    return log.select("id", F.when(F.col("answer").isNull(), "error").otherwise("done").alias("status"),
                      F.coalesce("answer", F.lit("")).alias("text"), start.alias("started_at"),
                      F.col("ts").alias("ended_at"),
                      F.coalesce("relevant", F.create_map().cast("map<string,boolean>")).alias("relevant"))
