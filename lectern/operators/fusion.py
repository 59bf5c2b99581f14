"""Rank fusion, the refusal gate, reranking, and the packing of sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vectors as V
from ..session import ensure_checkpoint_dir
from .lexical import lexical_topk
from .nearest import dense_topk
from .parallel import broadcast_if_small

MIN_SCORE = 0.35
CANDIDATES = 20
TOP_K = 5
RRF_K = 60


def with_cosine(hits: DataFrame, questions: DataFrame, chunks: DataFrame, digits: int = 6) -> DataFrame:
    """Add the cosine ``score`` of (question, chunk) to hits that were found by other means."""
    j = (hits.join(questions.select("question_id", F.col("vec").alias("_q")), "question_id")
         .join(chunks.select("chunk_id", F.col("vec").alias("_c")), "chunk_id"))
    return j.withColumn("score", F.round(V.dot(F.col("_q"), F.col("_c")), digits)).drop("_q", "_c")


def rrf(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per question.

    Each list adds 1/(k + rank). A missing rank stays NULL; ties go to the higher cosine, then the lower chunk id.
    """
    d = dense.select("question_id", "chunk_id", F.col("score").alias("_d"), F.col("rank").alias("dense_rank"))
    x = lexical.select("question_id", "chunk_id", F.col("score").alias("_x"), F.col("rank").alias("lex_rank"),
                       "all_terms")
    g = d.join(x, ["question_id", "chunk_id"], "full_outer").select(
        "question_id", "chunk_id", F.coalesce("_d", "_x").alias("score"), "dense_rank", "lex_rank", "all_terms")
    part = [F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "lex_rank")]
    g = g.withColumn("rrf", F.round(part[0] + part[1], 12))
    w = Window.partitionBy("question_id").orderBy(F.desc("rrf"), F.desc("score"), "chunk_id")
    return g.withColumn("rank", F.row_number().over(w))


def answerable(hits: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Per question: is anything semantically close, or does one chunk hold every keyword?"""
    ok = F.col("score") >= min_score
    if "all_terms" in hits.columns:
        ok = ok | F.coalesce("all_terms", F.lit(False))
    return hits.groupBy("question_id").agg(F.bool_or(ok).alias("answerable"))


def _gate(hits: DataFrame, top_k: int, min_score: float) -> DataFrame:
    """Mark the first ``top_k`` hits of answerable questions as used. Hits per question are bounded (candidates)."""
    ok = F.col("score") >= min_score
    if "all_terms" in hits.columns:
        ok = ok | F.coalesce("all_terms", F.lit(False))
    any_ok = F.bool_or(ok).over(Window.partitionBy("question_id"))
    return hits.withColumn("used", any_ok & (F.col("rank") <= top_k))


def retrieve(questions: DataFrame, chunks: DataFrame, mode: str = "dense", k: int | None = None,
             index: DataFrame | None = None, scope: str | None = None, rerank_with=None,
             candidate_k: int = CANDIDATES, top_k: int = TOP_K, min_score: float = MIN_SCORE, rrf_k: int = RRF_K,
             exclude_self: bool = False, dense: DataFrame | None = None) -> DataFrame:
    """Ranked candidates per question with a ``used`` flag (the ones an answer would be built from).

    Plain dense: the first ``k`` (default ``top_k``) hits, each used when it reaches ``min_score``. Hybrid, or any mode
    with ``rerank_with(hits) -> hits``: the first ``top_k`` are used if the question is answerable at all.
    ``questions`` needs ``question_id, vec`` (and ``terms`` for hybrid), ``chunks`` needs ``chunk_id, vec``.
    ``dense`` are hits of a vector search made before, deep enough for this mode; several modes can share it.
    """
    if mode == "dense":
        depth = k or top_k
        want = max(depth, candidate_k) if rerank_with is not None else depth
        hits = (dense_topk(questions, chunks, want, scope, exclude_self=exclude_self) if dense is None
                else dense.filter(F.col("rank") <= want))
    elif mode == "hybrid":
        if dense is None:
            dense = dense_topk(questions, chunks, candidate_k, scope, exclude_self=exclude_self)
        dense = dense.filter(F.col("rank") <= candidate_k)
        lexical = lexical_topk(questions, index, candidate_k + int(exclude_self), scope)
        if exclude_self:
            w = Window.partitionBy("question_id").orderBy("rank")
            lexical = (lexical.filter("question_id <> chunk_id").withColumn("rank", F.row_number().over(w))
                       .filter(F.col("rank") <= candidate_k))
        hits = rrf(dense, with_cosine(lexical, questions, chunks), rrf_k)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if rerank_with is not None:
        return _gate(rerank_with(hits), top_k, min_score)
    if mode == "dense":
        return hits.withColumn("used", F.col("score") >= min_score)
    return _gate(hits, top_k, min_score)


def rerank(hits: DataFrame, logits: DataFrame, candidate_k: int = CANDIDATES) -> DataFrame:
    """Reorder the first ``candidate_k`` hits by the sigmoid of a pair score (question_id, chunk_id, logit).

    The old position is kept as ``dense_rank``. A question with any missing score keeps its plain order.
    """
    first = hits.filter(F.col("rank") <= candidate_k)
    keep = [c for c in first.columns if c not in ("rank", "dense_rank")]
    j = first.join(logits.select("question_id", "chunk_id", "logit"), ["question_id", "chunk_id"], "left")
    failed = F.bool_or(F.col("logit").isNull() | F.isnan("logit")).over(Window.partitionBy("question_id"))
    j = j.withColumn("rerank_score", F.when(~failed, F.round(1 / (1 + F.exp(-F.col("logit"))), 9)))
    w = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return j.withColumn("_new", F.row_number().over(w)).select(
        *keep, F.col("rank").alias("dense_rank"), "rerank_score", F.col("_new").alias("rank"))


def overlap_logits(hits: DataFrame, questions: DataFrame, index: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """Native pair score: share of the question's idf weight found in the chunk, stretched to -4..4.

    ``n_chunks`` is a one-row frame with column ``n``. Only the terms of the questions are looked up in the index, which is read
    once: what holds them is kept for the frequencies and the candidates alike.
    """
    ensure_checkpoint_dir(questions.sparkSession)
    terms = questions.select("question_id", F.explode("terms").alias("term"))
    index = index.select("chunk_id", "term").join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi").checkpoint()
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term", "left").withColumn(
        "idf", F.log(1 + n_chunks.select("n").scalar() / (1 + F.coalesce("df", F.lit(0)))))
    total = weighted.groupBy("question_id").agg(F.sum("idf").alias("_total"))
    pairs = hits.select("question_id", "chunk_id")
    matched = (pairs.join(weighted.select("question_id", "term", "idf"), "question_id")
               .join(index.select("chunk_id", "term"), ["chunk_id", "term"], "left_semi")
               .groupBy("question_id", "chunk_id").agg(F.sum("idf").alias("_hit")))
    j = pairs.join(total, "question_id", "left").join(matched, ["question_id", "chunk_id"], "left")
    share = F.when(F.col("_total") > 0, F.coalesce("_hit", F.lit(0.0)) / F.col("_total")).otherwise(0.0)
    return j.select("question_id", "chunk_id", (8 * share - 4).alias("logit"))


Scorer = Callable[[str, list[str]], list[float]]


def scored_by(pairs: DataFrame, scorer: Scorer, question: str = "question", text: str = "text") -> DataFrame:
    """Pair scores of a user model: question_id, chunk_id, logit (NaN where the model failed).

    ``scorer(question, texts)`` is called once per question with all of its texts (a bounded candidate list, best first
    only if ``pairs`` has it so), in executors.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_id", kind="stable")
        try:
            logit = np.asarray(scorer(pdf[question].iloc[0], pdf[text].tolist()), dtype=float)
        except Exception:  # noqa: BLE001 -- that question falls back to the plain order
            logit = np.full(len(pdf), np.nan)
        return pdf[["question_id", "chunk_id"]].assign(logit=logit)

    schema = T.StructType([pairs.schema["question_id"], pairs.schema["chunk_id"],
                           T.StructField("logit", T.DoubleType())])
    return pairs.select("question_id", "chunk_id", question, text).groupBy("question_id").applyInPandas(run, schema)


DEFAULT_TEMPLATE = ("Use only the numbered sources and cite them like [1] or [2][3]. Say so if they do not hold the "
                    "answer. Reply in {language}.\n\nSources:\n\n")
LANGUAGE_NAMES = {"ar": "Arabic", "fr": "French", "en": "English"}


def build_context(sources: DataFrame, with_summary: bool = True) -> DataFrame:
    """One text per question: ``[i] (title, where)``, an optional line about the file, the passage; in rank order.

    Sources per question are bounded by ``top_k``.
    """
    about = F.lit("")
    if with_summary:
        about = F.when(F.coalesce("summary", F.lit("")) != "",
                       F.concat(F.lit("About this file: "), X.first_sentence(F.col("summary")), F.lit("\n"))
                       ).otherwise("")
    where = X.locator(F.col("mime"), F.col("page"), F.col("label"))
    body = F.concat(F.lit("("), "title", F.lit(", "), where, F.lit(")\n"), about, "text")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank"), body.alias("body"))))
    lines = F.transform(ordered, lambda s, i: F.concat(F.lit("["), i + 1, F.lit("] "), s["body"]))
    return sources.groupBy("question_id").agg(F.array_join(lines, "\n\n").alias("context"))


def build_messages(contexts: DataFrame, question: str = "question", template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Add ``system`` and ``user`` texts; the reply language is the question's."""
    lang = X.detect_lang(F.col(question))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv]), lang)
    system = F.concat(F.replace(F.lit(template), F.lit("{language}"), name), F.col("context"))
    return contexts.withColumn("system", system).withColumn("user", F.col(question))


def pack_retrieved(hits: DataFrame) -> DataFrame:
    """Candidates of each question as one JSON list for the log: ids, rounded score, rank, used, optional ranks."""
    optional = [c for c in ("dense_rank", "lex_rank") if c in hits.columns]
    rounded = [F.bround(c, n).alias(c) for c, n in (("rrf", 5), ("rerank_score", 4)) if c in hits.columns]
    item = F.struct(F.col("rank"), "chunk_id", F.bround("score", 4).alias("score"), "used", *optional, *rounded)
    return hits.groupBy("question_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("retrieved"))
