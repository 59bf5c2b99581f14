"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scan import global_rank
from ..session import ensure_checkpoint_dir
from .common import whole_row

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sample_key(doc_id: Column, seed: int) -> Column:
    """The order in which a source's documents are drawn: pseudo-random, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Targets of ``sources(source, source_size, weight)``: shares of the whole by weight, at most ``max_epochs`` times
    a source's size; what a clamped source can't take goes to the others by weight, until none is above.

    One small aggregate per round. Each round clamps at least one more source, so it ends; with nothing to share
    (no sources, or all empty) every target is 0.
    """
    cap, weight = F.col("source_size") * max_epochs, F.col("weight")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while total:
        full = weight * F.lit(level) > cap
        n, used, left = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
                                    F.coalesce(F.sum(F.when(~full, weight)), F.lit(0))).first()
        if n == clamped or not left:
            break
        clamped, level = n, (total - used) / left
    return sources.withColumn("target", F.least(cap.cast("double"), weight * F.lit(float(level))))


def plan(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3,
         digits: Sequence[int] = (3, 6, 32)) -> DataFrame:
    """One row per source of ``rows(source, size, key)``: ``source_size``, ``weight``, ``target``, whole repetitions
    ``whole`` and the last ``key`` that gets one repetition more (``cut``; null: none).

    Sources in code-point order, null last, take the weights in turn. The documents of a source are drawn in key order
    until their sizes come nearest the fractional part of its target. The place is found by prefixes of the key: sums
    by the first 3 digits, then inside one prefix by 6, then by whole keys, so no source has to fit one task.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "_rank")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    sources = ranked.select("source", "source_size",
                            F.element_at(turn, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).alias("weight"))
    filled = water_fill(sources.checkpoint(), max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    need = F.col("target") - F.col("whole") * F.col("source_size")
    scope = filled.select(F.col("source").alias("_source"), need.alias("_need"), F.lit("").alias("_prefix"),
                          F.lit(0).cast("bigint").alias("_base")).filter("_need > 0")
    for n in digits:
        inside = rows.join(scope, F.col("source").eqNullSafe(F.col("_source"))
                           & F.col("key").startswith(F.col("_prefix")))
        sums = inside.groupBy("_source", "_need", "_base", "_prefix", F.substring("key", 1, n).alias("_next")).agg(
            F.sum("size").alias("_size"))
        order = Window.partitionBy("_source").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        upto = sums.withColumn("_upto", F.col("_base") + F.sum("_size").over(order))
        if n != digits[-1]:
            scope = upto.filter("_upto >= _need AND _upto - _size < _need").select(
                "_source", "_need", F.col("_next").alias("_prefix"), (F.col("_upto") - F.col("_size")).alias("_base"))
            scope = scope.checkpoint()
    nearer = F.col("_upto") - F.col("_need") <= F.col("_need") - (F.col("_upto") - F.col("_size"))
    cuts = upto.groupBy("_source").agg(
        F.coalesce(F.max(F.when(nearer, F.col("_next"))), F.max("_prefix")).alias("cut"))
    return (filled.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").checkpoint())


#: Columns that a mix adds.
ADDED = ("_size", "_source_size", "_target", "_repeats")


def _mixed(docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: int) -> DataFrame:
    """Each row of ``docs`` as one struct ``row``, with the columns of ``ADDED``."""
    ensure_checkpoint_dir(docs.sparkSession)
    key = sample_key(F.col("doc_id"), seed)
    rows = docs.select("source", n_words(F.col("text")).alias("size"), key.alias("key")).checkpoint()
    planned = plan(rows, weights, max_epochs).select(
        F.col("source").alias("_plan_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "whole", "cut")
    extra = F.coalesce(F.col("_key") <= F.col("cut"), F.lit(False)).cast("bigint")
    own = docs.select(whole_row(docs), F.col("source").alias("_own"), key.alias("_key"), n_words(F.col("text")).alias("_size"))
    return own.join(planned, F.col("_own").eqNullSafe(F.col("_plan_source"))).withColumn("_repeats", F.col("whole") + extra).select("row", *ADDED)


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_repeats`` (0 to ``max_epochs``) put behind its columns.

    Null texts have size 0; a null source is a source of its own; rows repeated under one ``doc_id`` are drawn
    together; an empty table gives an empty table. Columns of ``docs`` that have the name of an added one give way to it;
    all others pass through. Texts aren't shuffled: the one-row-per-source plan is joined, and Spark broadcasts it where
    its measured size permits.
    """
    return _mixed(docs, weights, max_epochs, seed).select(
        *(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED), *ADDED)


def repeated(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs`` with their own columns, of whatever names, each as often as it was drawn."""
    drawn = _mixed(docs, weights, max_epochs, seed).filter("_repeats > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("_repeats")))).select("row.*")
