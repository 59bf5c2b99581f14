"""Summaries, concepts and tags per document: state, queue, grouping, map-reduce, clean-up, guarded write."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import ensure_checkpoint_dir
from .chunking import group_ids

FAN_IN = 8
MAX_TAG_CHARS = 40


def _stale() -> Column:
    return ~F.col("enriched_sha").eqNullSafe(F.col("sha256"))


def enrich_state(docs: DataFrame) -> DataFrame:
    """Add ``state``: skipped, pending (summary missing or of an older content), else the stored status."""
    state = F.when(F.col("status") != "ok", "skipped").when(_stale(), "pending").otherwise(F.col("enrich_status"))
    return docs.withColumn("state", state)


def state_counts(docs: DataFrame) -> DataFrame:
    """Documents per state, zero-filled."""
    axis = docs.sparkSession.createDataFrame([(s,) for s in ("ok", "error", "pending", "skipped")], "state string")
    n = enrich_state(docs).groupBy("state").agg(F.count("*").alias("n"))
    return axis.join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def pending(docs: DataFrame) -> DataFrame:
    """The work queue, oldest first."""
    return docs.filter((F.col("status") == "ok") & _stale()).orderBy("ingested_at", "doc_id")


def rerun(docs: DataFrame, course: str | None = None, doc_id: int | None = None) -> DataFrame:
    """Queue a course or one document again."""
    hit = (F.col("status") == "ok") & ((F.col("doc_id") == F.lit(doc_id)) | (F.col("course") == F.lit(course)))
    return docs.withColumn("enriched_sha", F.when(~F.coalesce(hit, F.lit(False)), F.col("enriched_sha")))


def distinct_ignoring_case(items: Column, cap: int) -> Column:
    """Non-empty items, first spelling kept, at most ``cap``."""

    def unique(xs: Column) -> Column:
        return X.let(F.transform(xs, lambda x: F.lower(x)),
                     lambda low: F.filter(xs, lambda x, i: (x != "") & (F.array_position(low, F.lower(x)) == i + 1)))

    return F.slice(X.let(items, unique), 1, cap)


def clean_enrichment(df: DataFrame) -> DataFrame:
    """Tidy model replies (``summary, concepts, tags``); a reply without one of them becomes an error row."""
    summary = X.strip(F.coalesce("summary", F.lit("")))
    bad = (summary == "") | F.col("concepts").isNull() | F.col("tags").isNull()
    concepts = distinct_ignoring_case(F.transform("concepts", X.squeeze), 10)
    tags = F.filter(F.transform("tags", lambda x: X.squeeze(F.lower(x))), lambda x: F.length(x) <= MAX_TAG_CHARS)
    return df.select(
        *[c for c in df.columns if c not in ("summary", "concepts", "tags")],
        F.when(~bad, summary).alias("summary"), F.when(~bad, concepts).alias("concepts"),
        F.when(~bad, distinct_ignoring_case(tags, 8)).alias("tags"), F.when(bad, "error").otherwise("ok").alias("status"),
        F.when(bad, "the model's reply is missing a summary, concepts or tags").alias("error"))


def apply_if_current(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Write results back only where the content they were made from is still the document's content.

    ``results``: doc_id, sha256, summary, concepts, tags, status, error. A stale result changes nothing, so its
    document stays in the queue.
    """
    r = results.select("doc_id", "sha256", *[F.col(c).alias(f"_{c}") for c in
                                             ("summary", "concepts", "tags", "status", "error")])
    j = docs.join(r, ["doc_id", "sha256"], "left")
    hit = F.col("_status").isNotNull()

    def pick(name: str) -> Column:
        new = {"summary": F.col("_summary"), "concepts": F.col("_concepts"), "raw_tags": F.col("_tags"),
               "enriched_sha": F.col("sha256"), "enrich_status": F.col("_status"), "enrich_error": F.col("_error"),
               "summary_vec": F.lit(None)}.get(name)
        return F.col(name) if new is None else F.when(hit, new).otherwise(F.col(name)).alias(name)

    return j.select(*[pick(c) for c in docs.columns])


Summariser = Callable[[list[str]], list[str]]


def leading_sentences(text: Column, n: int = 3) -> Column:
    """Native summary: the ``n`` sentences with the most distinct words, in their original order."""

    def best(sentences: Column) -> Column:
        scored = F.transform(sentences, lambda s, i: F.struct(
            (-F.size(F.array_distinct(X.words_of(s)))).alias("rank"), i.alias("i"), s.alias("s")))
        top = F.slice(F.array_sort(scored), 1, n)
        return F.array_join(F.transform(F.array_sort(F.transform(top, lambda x: F.struct(
            x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"]), " ")

    return X.let(F.filter(F.transform(F.split(text, X.SENTENCE_GAP), X.squeeze), lambda s: s != ""), best)


def _summarise_column(df: DataFrame, summariser: Summariser | None) -> DataFrame:
    if summariser is None:
        return df.withColumn("text", leading_sentences(F.col("text"))).withColumn("failed", F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            try:
                out = list(summariser(texts))
            except Exception:  # noqa: BLE001 -- the retry below finds out which ones fail
                out = [None] * len(texts)
            for i, text in enumerate(texts):
                if out[i] is None:
                    try:
                        out[i] = summariser([text])[0]
                    except Exception:  # noqa: BLE001 -- a failing document becomes an error row
                        out[i] = None
            yield pdf.assign(text=out, failed=[x is None for x in out])

    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]  # a failed call leaves a NULL text
    return df.mapInPandas(run, T.StructType([*fields, T.StructField("failed", T.BooleanType())]))


def summarise(chunks: DataFrame, summariser: Summariser | None = None, budget: int = 2500,
              fan_in: int = FAN_IN) -> DataFrame:
    """Map-reduce summaries: doc_id, summary, calls, status.

    Chunks (doc_id, ord, text, n_tokens) are packed to the budget and each group is summarised; then ``fan_in``
    summaries at a time are summarised again until one is left. Documents run side by side and a document's groups
    too; the number of rounds is the logarithm of its group count. The text of one call is bounded by the budget.
    """
    spark = chunks.sparkSession
    ensure_checkpoint_dir(spark)
    # chunks are made and moved once: numbered in a row per document, bounded by its own text, and grouped where they are
    held = chunks.filter("doc_id IS NOT NULL AND ord IS NOT NULL").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "n_tokens", "text"))).alias("chunk"))
    numbered = held.withColumn("part", group_ids(F.transform("chunk", lambda c: c["n_tokens"]), budget))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("chunk")), lambda c: c["text"]), "\n\n")
    parts = numbered.select("doc_id", F.inline(F.arrays_zip("chunk", "part"))).groupBy("doc_id", "part").agg(body.alias("text"))
    parts = _summarise_column(parts, summariser).withColumn("calls", F.lit(1)).checkpoint()
    most = parts.agg(F.max("part")).first()[0] or 0
    while most > 0:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))),
                                          lambda c: F.coalesce(c["text"], F.lit(""))), "\n\n")
        open_docs = parts.groupBy("doc_id").agg(F.max("part").alias("_last"))
        j = parts.join(open_docs, "doc_id")
        done = j.filter("_last = 0").select("doc_id", "part", "text", "failed", "calls")
        merged = (j.filter("_last > 0").groupBy("doc_id", F.floor(F.col("part") / fan_in).cast("int").alias("part"))
                  .agg(joined.alias("text"), F.bool_or("failed").alias("_f"), F.sum("calls").alias("calls")))
        again = _summarise_column(merged, summariser).select(
            "doc_id", "part", "text", (F.col("failed") | F.col("_f")).alias("failed"),
            (F.col("calls") + 1).cast("int").alias("calls"))
        parts = done.unionByName(again).checkpoint()
        most //= fan_in
    return parts.select("doc_id", F.when(~F.col("failed"), F.col("text")).alias("summary"), "calls",
                        F.when(F.col("failed"), "error").otherwise("ok").alias("status"))
