"""The tag vocabulary of each course: new raw tags, clustering onto known tags, links, edits.

A NULL course is a course of its own, so joins on it are null-safe.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import ensure_checkpoint_dir
from .nearest import _matrix, block_join

THRESHOLD = 0.85
MAX_NAME = 40
DIGITS = 6


def normalise_name(col: Column) -> Column:
    return X.squeeze(F.lower(col))


def _raw_tags(docs: DataFrame) -> DataFrame:
    """Distinct raw tags of each enriched document: doc_id, course, raw."""
    ok = docs.filter((F.col("enrich_status") == "ok") & F.col("raw_tags").isNotNull())
    return ok.select("doc_id", "course", F.explode(F.array_distinct("raw_tags")).alias("raw"))


def _on_alias(left: DataFrame, aliases: DataFrame, how: str) -> DataFrame:
    a = aliases.select(F.col("course").alias("_ac"), F.col("raw").alias("_ar"),
                       *[F.col(c) for c in aliases.columns if c not in ("course", "raw")])
    return left.join(a, (F.col("raw") == F.col("_ar")) & F.col("course").eqNullSafe(F.col("_ac")), how)


def new_raw_tags(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Raw tags without an alias and how many documents of the course use them, most used first."""
    freq = _raw_tags(docs).groupBy("course", "raw").agg(F.count("*").alias("freq"))
    return _on_alias(freq, aliases.select("course", "raw"), "left_anti").orderBy("course", F.desc("freq"), "raw")


def missed_modules(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Courses with a raw tag that no vocabulary pass has looked at."""
    return _on_alias(_raw_tags(docs), aliases.select("course", "raw"), "left_anti").select("course").distinct()


def relink(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, tag_id from raw tags through the aliases; raw forms of deleted tags (NULL tag) are dropped."""
    live = aliases.filter("tag_id IS NOT NULL")
    return _on_alias(_raw_tags(docs), live, "inner").select("doc_id", "tag_id").distinct()


def prune_tags(tags: DataFrame, doc_tags: DataFrame) -> DataFrame:
    """Drop tags no document has, unless a user named them."""
    used = doc_tags.select("tag_id").distinct().withColumn("_u", F.lit(True))
    return tags.join(used, "tag_id", "left").filter(F.col("_u").isNotNull() | F.col("user_named")).drop("_u")


def list_tags(tags: DataFrame, doc_tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tags with their document count and the other raw forms merged into them."""
    n = doc_tags.groupBy("tag_id").agg(F.count("*").alias("count"))
    forms = (aliases.select("tag_id", "raw").join(tags.select("tag_id", "name"), "tag_id").filter("raw <> name")
             .groupBy("tag_id").agg(F.sort_array(F.collect_list("raw")).alias("raws")))
    j = tags.join(n, "tag_id", "left").join(forms, "tag_id", "left")
    return (j.withColumn("count", F.coalesce("count", F.lit(0)))
            .withColumn("raws", F.coalesce("raws", F.array().cast("array<string>")))
            .orderBy(F.asc_nulls_last("course"), F.desc("count"), "name"))


def judge_edits(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """Add ``verdict`` to edits (op, tag_id, into, name): ok, missing, bad name, clash, or other module."""
    mine = tags.select("tag_id", F.col("course").alias("_course"), F.lit(True).alias("_have"))
    other = tags.select(F.col("tag_id").alias("into"), F.col("course").alias("_into_course"), F.lit(True).alias("_into"))
    named = tags.select(F.col("course").alias("_nc"), F.col("name").alias("_nn"), F.col("tag_id").alias("_nid"))
    e = edits.withColumn("name", normalise_name(F.col("name")))
    j = e.join(mine, "tag_id", "left").join(other, "into", "left").join(
        named, (F.col("name") == F.col("_nn")) & F.col("_course").eqNullSafe(F.col("_nc"))
        & (F.col("tag_id") != F.col("_nid")) & (F.col("op") == "rename"), "left")
    size = F.coalesce(F.length("name"), F.lit(0))
    verdict = (F.when(F.col("_have").isNull(), "missing")
               .when((F.col("op") == "rename") & ((size == 0) | (size > MAX_NAME)), "bad name")
               .when((F.col("op") == "rename") & F.col("_nid").isNotNull(), "clash")
               .when((F.col("op") == "merge") & (F.col("_into").isNull() | (F.col("into") == F.col("tag_id"))), "missing")
               .when((F.col("op") == "merge") & ~F.col("_course").eqNullSafe(F.col("_into_course")), "other module")
               .otherwise("ok"))
    return j.select(*edits.columns, verdict.alias("verdict"))


def apply_tag_edits(tags: DataFrame, aliases: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, aliases) after a batch of edits, at most one per tag; edits that are not ``ok`` change nothing.

    Rename and merge mark the surviving tag as user-named. Merge repoints the source's aliases. Delete keeps the
    aliases with a NULL tag, so that later passes keep the raw forms dropped.
    """
    good = judge_edits(tags, edits).filter("verdict = 'ok'").drop("verdict")
    renamed = good.filter("op = 'rename'").select("tag_id", normalise_name(F.col("name")).alias("_name"))
    removed = good.filter("op IN ('merge', 'delete')").select("tag_id", F.lit(True).alias("_gone"),
                                                             F.when(F.col("op") == "merge", F.col("into")).alias("_into"))
    merged_into = good.filter("op = 'merge'").select(F.col("into").alias("tag_id")).distinct().withColumn(
        "_named", F.lit(True))
    t = (tags.join(renamed, "tag_id", "left").join(merged_into, "tag_id", "left")
         .join(removed.select("tag_id"), "tag_id", "left_anti"))
    named = F.col("user_named") | F.col("_name").isNotNull() | F.col("_named").isNotNull()
    t = t.withColumn("name", F.coalesce("_name", "name")).withColumn("user_named", named).select(*tags.columns)
    a = aliases.join(removed, "tag_id", "left").withColumn(
        "tag_id", F.when(F.col("_gone"), F.col("_into")).otherwise(F.col("tag_id")))
    return t, a.select(*aliases.columns)


# --- clustering -----------------------------------------------------------------------------------------------------

_SEEN = T.StructType([T.StructField("id", T.StringType()), T.StructField("leader", T.BooleanType()),
                      T.StructField("open", T.BooleanType())])
_LINK = T.StructType([T.StructField("id", T.StringType()), T.StructField("to", T.StringType()),
                      T.StructField("sim", T.DoubleType()), T.StructField("to_freq", T.LongType())])


def _earlier(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Boolean matrix: does the right item come before the left one (known tags, then by frequency, then name)?"""
    freq = np.concatenate([left["freq"].to_numpy(), right["freq"].to_numpy()])
    ids = np.array(left["id"].to_pylist() + right["id"].to_pylist(), dtype=object)
    place = np.empty(len(freq), dtype=np.int64)
    place[np.lexsort((ids, -freq))] = np.arange(len(freq))
    n = left.num_rows
    return place[None, n:] < place[:n, None]


def _similar(left: pa.Table, right: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    sims = np.round(_matrix(left["vec"]) @ _matrix(right["vec"]).T, DIGITS)
    same = np.array(left["id"].to_pylist(), dtype=object)[:, None] == np.array(
        right["id"].to_pylist(), dtype=object)[None, :]
    return sims, (sims >= threshold) & _earlier(left, right) & ~same


def _look(threshold: float):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        _, near = _similar(left, right, threshold)
        lead = np.array(right["leader"].to_pylist(), dtype=bool)
        return pa.table({"id": left["id"], "leader": (near & lead).any(axis=1), "open": (near & ~lead).any(axis=1)})

    return kernel


def _link(threshold: float):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pa.array(np.lexsort((np.array(right["id"].to_pylist(), dtype=object),
                                                -right["freq"].to_numpy()))))
        sims, near = _similar(left, right, threshold)
        best = np.where(near, sims, -np.inf).argmax(axis=1)
        rows = np.flatnonzero(near.any(axis=1))
        pick = best[rows]
        return pa.table({"id": left["id"].take(pa.array(rows)), "to": right["id"].take(pa.array(pick)),
                         "sim": sims[rows, pick], "to_freq": right["freq"].to_numpy()[pick]})

    return kernel


def vocab_pass(tags: DataFrame, new_raw: DataFrame, threshold: float = THRESHOLD, block: int = 2048) -> DataFrame:
    """Link every new raw tag to a tag: course, raw, tag (a known tag's id or a new tag's raw form), created.

    In order of frequency then name, a raw tag joins the closest tag known so far if it is close enough, else it
    becomes a tag itself. ``tags``: tag_id, course, vec. ``new_raw``: course, raw, freq, vec (unit vectors).

    That order-dependent rule is solved for all courses at once in rounds instead of one item after the other. An
    item becomes a tag once no earlier item close to it is undecided or a tag; it is settled as a member once any
    earlier close item is a tag. Each round decides at least the first open item of every course, usually nearly all.
    Comparisons run block against block and return one row per item, so a course with most of the tags is many tasks.
    """
    ensure_checkpoint_dir(tags.sparkSession)
    part = F.concat(F.when(F.col("course").isNull(), "0").otherwise("1"), F.coalesce(F.col("course").cast("string"), F.lit("")))
    # known tags come first: a frequency above any real one, and their ids in order behind a fixed-width prefix
    known = tags.select(part.alias("part"), F.concat(F.lit("k"), F.lpad(F.col("tag_id").cast("string"), 20, "0")).alias("id"),
                        F.lit(2 ** 62).cast("bigint").alias("freq"), F.col("vec").alias("vec"), F.lit(True).alias("leader"))
    todo = new_raw.select(part.alias("part"), F.concat(F.lit("r"), "raw").alias("id"), F.col("freq").cast("bigint").alias("freq"),
                          F.col("vec").alias("vec"), F.lit(False).alias("leader"))
    key = ["part", "id"]
    # one item id per course: blocks never mix courses, so (part, id) is what identifies an item
    leaders, undecided = known, todo.checkpoint()
    created, members = [], []
    while not undecided.isEmpty():
        others = leaders.unionByName(undecided)
        seen = block_join(_tagged(undecided), _tagged(others), _look(threshold), _SEEN, block)
        seen = _untag(seen).groupBy(*key).agg(F.bool_or("leader").alias("_l"), F.bool_or("open").alias("_o"))
        j = undecided.join(seen, key, "left")
        near_tag, near_open = F.coalesce("_l", F.lit(False)), F.coalesce("_o", F.lit(False))
        judged = j.withColumn("_to", F.when(near_tag, "member").when(near_open, "open").otherwise("tag")).drop(
            "_l", "_o").checkpoint()
        fresh = judged.filter("_to = 'tag'").drop("_to").withColumn("leader", F.lit(True))
        leaders = leaders.unionByName(fresh)
        created.append(fresh)
        members.append(judged.filter("_to = 'member'").drop("_to"))
        undecided = judged.filter("_to = 'open'").drop("_to")
    raw = F.substring(F.col("id"), 2, 2 ** 30)
    made = _union(created, todo).select(*key, F.col("id").alias("to"), F.lit(True).alias("created"))
    linked = block_join(_tagged(_union(members, todo)), _tagged(leaders), _link(threshold), _LINK, block)
    order = F.struct((-F.col("sim")).alias("s"), (-F.col("to_freq")).alias("f"), F.col("to"))
    linked = _untag(linked).groupBy(*key).agg(F.min(order)["to"].alias("to")).withColumn("created", F.lit(False))
    out = made.unionByName(linked)
    target = F.when(F.col("to").startswith("k"), F.regexp_replace("to", "^k0*(?=.)", "")).otherwise(F.substring("to", 2, 2 ** 30))
    return out.select(F.when(F.col("part") != "0", F.substring("part", 2, 2 ** 30)).alias("course"), raw.alias("raw"),
                      target.alias("tag"), F.col("to").startswith("k").alias("known"), "created")


def _tagged(df: DataFrame) -> DataFrame:
    """Carry the course inside the id, since blocks return ids only."""
    return df.withColumn("id", F.concat("id", F.lit("\u0001"), "part"))


def _untag(df: DataFrame) -> DataFrame:
    cut = F.split("id", "\u0001", 2)
    out = df.withColumn("part", F.element_at(cut, 2)).withColumn("id", F.element_at(cut, 1))
    return out.withColumn("to", F.element_at(F.split("to", "\u0001", 2), 1)) if "to" in df.columns else out


def _union(frames: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0)
    for f in frames:
        out = out.unionByName(f)
    return out
