"""Browsing the document library: lists, roll-ups, facets, folders, what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .enrichment import enrich_state


def document_list(docs: DataFrame, chunks: DataFrame, doc_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents with chunk count, enrichment state and tags (by name), ordered by course (NULL last) and title.

    Chunks and tags are aggregated to one row per document before they meet it.
    """
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    named = doc_tags.join(tags.select("tag_id", "name"), "tag_id").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("name", "tag_id"))).alias("tags"))
    j = enrich_state(docs).join(n, "doc_id", "left").join(named, "doc_id", "left")
    none = F.array().cast(named.schema["tags"].dataType)
    return (j.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
            .withColumn("tags", F.coalesce("tags", none)).orderBy(F.asc_nulls_last("course"), "title"))


def library_rollup(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, chunks and unreadable documents per course."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("_n"))
    return (docs.join(n, "doc_id", "left").groupBy("course").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("_n"), F.lit(0)).alias("chunks"),
        F.count_if(F.col("status") != "ok").alias("problems")).orderBy(F.asc_nulls_last("course")))


def library_problems(docs: DataFrame) -> DataFrame:
    """Excluded and unreadable documents, and those whose current summary failed, with the list each belongs to."""
    kind = F.when(F.col("status") == "excluded", "excluded").when(F.col("status") != "ok", "unreadable").when(
        F.col("enriched_sha").eqNullSafe(F.col("sha256")) & (F.col("enrich_status") == "error"), "summary")
    return (docs.withColumn("list", kind).filter("list IS NOT NULL")
            .orderBy("list", F.asc_nulls_last("course"), "title"))


def courses(docs: DataFrame) -> DataFrame:
    return docs.filter("course IS NOT NULL").select("course").distinct().orderBy("course")


def filter_library(docs: DataFrame, doc_tags: DataFrame, course: str | None = None, q: str | None = None,
                   picked: list | None = None) -> DataFrame:
    """Documents of a course whose title, path, summary or concepts contain the text and that carry every tag."""
    if course is not None:
        docs = docs.filter(F.col("course") == course)
    if q and q.strip():
        hay = F.concat_ws(" ", "title", "path", F.coalesce("summary", F.lit("")),
                          F.array_join(F.coalesce("concepts", F.array().cast("array<string>")), " "))
        docs = docs.filter(X.icontains(hay, q.strip()))
    if picked:
        full = (doc_tags.filter(F.col("tag_id").isin(list(picked))).groupBy("doc_id")
                .agg(F.countDistinct("tag_id").alias("_n")).filter(F.col("_n") == len(set(picked))))
        docs = docs.join(full, "doc_id", "left_semi")
    return docs


def tag_facets(doc_tags: DataFrame, tags: DataFrame, picked: list | None = None) -> DataFrame:
    """Documents per tag, most used first; ``shown`` marks tags of two or more documents, and picked ones."""
    n = doc_tags.groupBy("tag_id").agg(F.count("*").alias("n"))
    shown = (F.col("n") >= 2) | F.col("tag_id").isin(list(picked or []))
    return n.join(tags, "tag_id").withColumn("shown", shown).orderBy(F.desc("n"), "name")


def natural_key(col: Column) -> Column:
    """Sort key: case and accents folded, digit runs padded so that 2 comes before 10."""
    return X.rewrite(X.fold_accents(col), r"\d+", lambda d: F.lpad(d, 12, "0"))


def group_by_folder(docs: DataFrame, course: str | None = None) -> DataFrame:
    """Documents with the folder heading they are filed under, in natural order."""
    folder = X.folder_trail(F.col("path"))
    if course is None:
        top = F.coalesce("course", F.lit("Loose notes"))
        key = F.when(folder == "", top).otherwise(F.concat(top, F.lit(" › "), folder))
    else:
        docs = docs.filter(F.col("course") == course)
        key = F.when(folder == "", "Top of the drawer").otherwise(folder)
    return docs.withColumn("folder", key).withColumn("_k", natural_key(F.col("folder"))).orderBy("_k").drop("_k")


def unseen(docs: DataFrame, seen: DataFrame, first_visit: str) -> DataFrame:
    """Add ``fresh``: filed after the first visit and not opened since."""
    s = seen.select("doc_id").distinct().withColumn("_seen", F.lit(True))
    late = F.col("first_seen") > F.to_timestamp_ntz(F.lit(first_visit))
    return docs.join(s, "doc_id", "left").withColumn("fresh", late & F.col("_seen").isNull()).drop("_seen")


def drawer_counts(docs: DataFrame, seen: DataFrame, first_visit: str, known: DataFrame) -> DataFrame:
    """Documents and unseen ones per course. Known modules (``course, unit``) come first, zero-filled."""
    n = (unseen(docs, seen, first_visit).filter("course IS NOT NULL").groupBy("course")
         .agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")))
    j = n.join(known, "course", "full_outer")
    return j.select("course", F.coalesce("unit", F.lit("other")).alias("unit"), F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce("fresh", F.lit(0)).alias("fresh")).orderBy(F.col("unit") == "other", "unit", "course")


def digest(docs: DataFrame, seen: DataFrame, first_visit: str, size: int = 8) -> DataFrame:
    """Per course: its unseen documents if there are any, else the latest ones; at most ``size``."""
    d = unseen(docs.filter("status = 'ok'"), seen, first_visit)
    w = Window.partitionBy("course").orderBy(
        F.desc("fresh"), F.when(F.col("fresh"), F.col("title")), F.desc("first_seen"), "doc_id")
    top = d.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= size)
    any_fresh = F.bool_or("fresh").over(Window.partitionBy("course"))
    return top.withColumn("_any", any_fresh).filter(F.col("fresh") | ~F.col("_any")).drop("_any")


def newest_filed(docs: DataFrame) -> DataFrame:
    return docs.agg(F.max("first_seen").alias("newest"))


def document_pages(page_cache: DataFrame, docs: DataFrame, doc_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per page of each document (label, text), with the document's tag names."""
    named = doc_tags.join(tags.select("tag_id", "name"), "tag_id").groupBy("doc_id").agg(
        F.sort_array(F.collect_list("name")).alias("tags"))
    pages = page_cache.select("sha256", F.inline("pages"))
    return (docs.join(pages, "sha256").join(named, "doc_id", "left")
            .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))))
