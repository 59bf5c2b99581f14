"""Evaluation sets and retrieval scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .scan import exact_median, global_rank, previous_value, running_total

MIN_TOKENS = 60
MIN_PER_GROUP = 5
DEPTH = 20
RATES = ["recall_1", "recall_5", "recall_20", "mrr", "refusal_rate"]


def page_pool(chunks: DataFrame, asked: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One passage per page: the first chunk long enough, of readable documents, unless the page was asked before.

    A minimum per page rather than a window, so only one candidate per page and task is shuffled.
    """
    long = chunks.filter((F.col("status") == "ok") & (F.col("n_tokens") >= min_tokens))
    first = long.groupBy("path", "page").agg(
        F.min_by(F.struct("course", "text"), F.col("ord")).alias("_f"))
    return (first.select("path", "page", "_f.course", "_f.text")
            .join(asked.select("path", "page").distinct(), ["path", "page"], "left_anti"))


def quotas(sizes: DataFrame, n: int, floor: int = MIN_PER_GROUP) -> DataFrame:
    """Questions per group: a round-robin floor, the rest in proportion to the room left, largest remainders first.

    ``sizes`` is one row per group: ``course, size``. Groups are ranked once by size; everything else is a few sums
    over all groups and running totals in blocks, so many groups are as fine as few.

    The groups of at least r rows are the first ones in size order. Round r of the floor therefore hands out a known
    stretch of places, and a group's share of the floor follows from its rank alone.
    """
    name = F.coalesce(F.col("course").cast("string"), F.lit("None"))
    s = global_rank(sizes.select("course", F.col("size").cast("bigint").alias("size")), [F.desc("size"), name], "_ord")
    total, *at_least = s.agg(F.sum("size"), *[F.count_if(F.col("size") >= r) for r in range(1, floor + 1)]).first()
    n = min(n, total or 0)
    before, given = 0, F.lit(0).cast("bigint")
    for r, groups in enumerate(at_least, start=1):
        given = given + ((F.col("size") >= r) & (F.col("_ord") <= n - before)).cast("bigint")
        before += groups
    s = s.withColumn("_q", given)

    used, room = s.agg(F.sum("_q"), F.sum(F.col("size") - F.col("_q"))).first()
    left = n - (used or 0)
    cap = F.col("size") - F.col("_q")
    share = F.lit(left) * cap / F.lit(room) if left > 0 else F.lit(0.0)
    s = s.withColumn("_share", share).withColumn("_q", F.col("_q") + F.least(cap, F.floor("_share")))
    short = n - (s.agg(F.sum("_q")).first()[0] or 0)
    if short > 0:
        open_ = s.filter(F.col("_q") < F.col("size")).select("_ord", (F.col("_share") - F.floor("_share")).alias("_rest"))
        turns = global_rank(open_, [F.desc("_rest"), F.asc("_ord")], "_turn").filter(F.col("_turn") <= short)
        s = s.join(turns.select("_ord", F.lit(1).alias("_extra")), "_ord", "left").withColumn(
            "_q", F.col("_q") + F.coalesce("_extra", F.lit(0)))
        short = n - s.agg(F.sum("_q")).first()[0]
    if short > 0:
        s = running_total(s.withColumn("_all", F.lit(1)), ["_all"], "_ord", F.col("size") - F.col("_q"), "_upto")
        ahead = F.col("_upto") - (F.col("size") - F.col("_q"))
        s = s.withColumn("_q", F.col("_q") + F.greatest(F.lit(0), F.least(
            F.col("size") - F.col("_q"), F.lit(short) - ahead)))
    return s.select("course", "size", F.col("_q").cast("bigint").alias("quota"))


def stratified_sample(pool: DataFrame, per_group: DataFrame, n: int, key: Column, seed: int = 1) -> DataFrame:
    """``quota`` rows per group in the order of a seeded hash of the row key.

    No group can need more than ``n`` rows, and that literal bound lets Spark cut every group before the shuffle.
    """
    order = F.md5(F.concat_ws(":", key, F.lit(str(seed))))
    w = Window.partitionBy("course").orderBy(order, key)
    best = pool.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    j = best.alias("b").join(per_group.alias("g"), F.col("b.course").eqNullSafe(F.col("g.course")))
    return j.filter("_r <= quota").select("b.*").drop("_r")


def _tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]+"), 0)


def ngrams(tokens: Column, n: int = 5) -> Column:
    """Runs of ``n`` consecutive tokens, joined by spaces."""

    def runs(words: Column) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return X.let(tokens, runs)


def reject_reason(question: Column, passage: Column) -> Column:
    """Why a generated question is unusable, or NULL: empty, too short, too long, or a copied 5-gram."""
    words = F.size(X.bounded_words(question))
    copied = F.arrays_overlap(ngrams(_tokens(question)), ngrams(_tokens(passage)))
    return (F.when(words == 0, "empty").when(words < 4, "too short").when(words > 40, "too long")
            .when(copied, "copies the passage"))


def shared_ngrams(a: DataFrame, b: DataFrame, a_id: str, text: str = "text", n: int = 5) -> DataFrame:
    """How many distinct n-grams of each row of ``a`` occur anywhere in ``b``: a_id, n_shared (0 rows left out).

    Shingles travel as hashes. The other side is reduced to distinct shingles first, so a popular one matches once
    per row of ``a`` instead of once per pair.
    """
    def shingles(df: DataFrame, *keep: str) -> DataFrame:
        grams = df.select(*keep, F.explode_outer(F.array_distinct(ngrams(_tokens(F.col(text)), n))).alias("g"))
        return grams.filter("g IS NOT NULL").select(*keep, F.md5("g").alias("h"))

    found = shingles(a, a_id).join(shingles(b).distinct(), "h", "left_semi")
    return found.groupBy(a_id).agg(F.countDistinct("h").alias("n_shared"))


def accept_questions(existing: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, counts per reject reason). A page takes one question: the first accepted by ``id``."""
    judged = candidates.withColumn("reason", reject_reason(F.col("question"), F.col("passage")))
    good = judged.filter("reason IS NULL").groupBy("path", "page").agg(
        F.min_by(F.struct(*[c for c in candidates.columns if c not in ("path", "page")]), F.col("id")).alias("_r"))
    fresh = good.select("path", "page", "_r.*").join(existing.select("path", "page"), ["path", "page"], "left_anti")
    reasons = judged.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    return fresh.select(*candidates.columns), reasons


def truth_set(questions: DataFrame, log: DataFrame) -> DataFrame:
    """Right pages per question: source, id, question, course, lang, path, page.

    Generated questions bring their page; log rows bring the pages of citations marked relevant, and rows without a
    positive mark drop out. ``log``: id, question, course, citations array<struct<n,path,page>>, relevant map.
    """
    made = questions.select(F.lit("generated").alias("source"), "id", "question", "course", "lang", "path", "page")
    cited = (log.filter(F.col("relevant").isNotNull())
             .select("id", "question", "course", "relevant", F.explode("citations").alias("c")))
    marked = F.coalesce(F.try_element_at("relevant", F.col("c.n").cast("string")), F.lit(False))
    real = cited.filter(marked).select(
        F.lit("real").alias("source"), "id", "question", "course", X.detect_lang(F.col("question")).alias("lang"),
        F.col("c.path").alias("path"), F.col("c.page").alias("page")).distinct()
    return made.unionByName(real)


def first_rank(questions: DataFrame, hits: DataFrame, truth: DataFrame, on: list[str], depth: int = DEPTH) -> DataFrame:
    """Rank of each question's first right hit within ``depth`` (NULL if none). ``on`` names the truth key."""
    right = (hits.filter(F.col("rank") <= depth).join(truth, on, "left_semi")
             .groupBy("question_id").agg(F.min("rank").alias("rank")))
    return questions.join(right, "question_id", "left")


def _rates() -> list[Column]:
    hit = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in (1, 5, 20)]
    return [F.count("*").alias("n"), *hit, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
            F.avg(F.col("refused").cast("double")).alias("refusal_rate")]


def _withhold(df: DataFrame) -> DataFrame:
    """A mode some question could not be run in has no numbers: n = 0 and every rate NULL."""
    out = df.withColumn("n", F.when(F.col("unavailable"), 0).otherwise(F.col("n")))
    return out.withColumns({c: F.when(~F.col("unavailable"), F.col(c)) for c in RATES})


def retrieval_metrics(items: DataFrame, *by: str) -> DataFrame:
    """recall@1/5/20, MRR (a miss counts 0), refusal rate and n per mode (and ``by``).

    ``items``: one row per (question, mode) with ``rank``, ``refused`` and optionally ``available``.
    """
    ok = F.col("available") if "available" in items.columns else F.lit(True)
    g = items.groupBy("mode", *by).agg(*_rates(), F.bool_or(~F.coalesce(ok, F.lit(False))).alias("unavailable"))
    return _withhold(g)


def metrics_by(items: DataFrame, keys: tuple[str, ...] = ("course", "lang", "source")) -> DataFrame:
    """The same scores overall and broken down by each key, in one pass of grouping sets.

    ``breakdown`` names the grouping, ``value`` its key (a NULL course is a group of its own, told apart from the
    total by the grouping).
    """
    ok = F.col("available") if "available" in items.columns else F.lit(True)
    sets = [[F.col("mode")], *[[F.col("mode"), F.col(k)] for k in keys]]
    g = items.groupingSets(sets, F.col("mode"), *[F.col(k) for k in keys]).agg(
        *_rates(), F.bool_or(~F.coalesce(ok, F.lit(False))).alias("unavailable"),
        *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    breakdown, value = F.lit("overall"), F.lit(None).cast("string")
    for k in keys:
        breakdown = F.when(F.col(f"_g_{k}") == 0, k).otherwise(breakdown)
        value = F.when(F.col(f"_g_{k}") == 0, F.col(k).cast("string")).otherwise(value)
    g = g.withColumn("breakdown", breakdown).withColumn("value", value)
    return _withhold(g).select("mode", "breakdown", "value", "n", *RATES, "unavailable")


def answer_metrics(items: DataFrame) -> DataFrame:
    """n, refusal rate, share of valid citations, share citing a right page, median ms (whole) of answered ones."""
    answered = ~F.col("refused")

    def share(c: str) -> Column:
        return F.avg(F.when(answered, F.coalesce(F.col(c), F.lit(False)).cast("double")))

    one = items.agg(
        F.count("*").alias("n"), F.avg(F.col("refused").cast("double")).alias("refusal_rate"),
        share("valid").alias("citation_valid_rate"), share("cited_right").alias("cited_right_rate"))
    median = exact_median(items.filter(answered), [], "ms", "_m")
    return one.join(F.broadcast(median), F.lit(True), "left").select(  # one row each
        "n", "refusal_rate", "citation_valid_rate", "cited_right_rate", F.col("_m").cast("bigint").alias("median_ms"))


def cited_right(citations: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Questions whose kept citations include a right page."""
    return citations.join(truth, on, "left_semi").select("question_id").distinct()


def run_deltas(runs: DataFrame, metric: str = "recall_5") -> DataFrame:
    """Add ``delta_points``: change of a metric against the previous run of the same kind, in whole points."""
    prev = previous_value(runs, ["kind"], "id", metric, "_prev")
    points = F.floor((F.col(metric) - F.col("_prev")) * 100 + 0.5).cast("bigint")
    return prev.withColumn("delta_points", points).drop("_prev")


def best_modes(values: DataFrame, keys: list[str], value: str = "value", lower_is_better: str = "lower") -> DataFrame:
    """Mark the best mode of every metric; none when fewer than two values are known or all of them tie.

    ``values``: keys, ``mode``, ``value``, ``lower`` (boolean). The modes of one metric are a handful of rows.
    """
    w = Window.partitionBy(*keys)
    known, low, high = F.count(value).over(w), F.min(value).over(w), F.max(value).over(w)
    top = F.when(F.col(lower_is_better), low).otherwise(high)
    is_best = (known >= 2) & (low < high) & (F.col(value) == top)
    return values.withColumn("is_best", F.coalesce(is_best, F.lit(False)))


def sweep(hits: DataFrame, questions: DataFrame, doc_vecs: DataFrame, truth_key: str, grid: list[float], k: int = 20,
          doc: str = "doc_id", digits: int = 6) -> DataFrame:
    """Scores of several document boosts in one job. Hits are fetched once and re-ranked per boost.

    ``hits`` and ``questions`` both carry ``truth_key``; a hit is right when they agree.
    """
    from ..functions.vectors import dot

    h = (hits.drop("rank").join(questions.select("question_id", F.col(truth_key).alias("_want"),
                                                 F.col("vec").alias("_q")), "question_id")
         .join(doc_vecs.select(doc, F.col("vec").alias("_d")), doc, "left"))
    h = h.withColumn("doc_score", F.round(F.coalesce(dot(F.col("_q"), F.col("_d")), F.lit(0.0)), digits))
    h = h.select("question_id", "chunk_id", "score", "doc_score",
                 F.col(truth_key).eqNullSafe(F.col("_want")).alias("_right"),
                 F.explode(F.array(*[F.lit(float(b)) for b in grid])).alias("boost"))
    key = F.round(F.col("score") + F.col("boost") * F.col("doc_score"), digits)
    w = Window.partitionBy("boost", "question_id").orderBy(F.desc(key), F.desc("score"), "chunk_id")
    ranked = h.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    first = ranked.groupBy("boost", "question_id").agg(F.min(F.when(F.col("_right"), F.col("_r"))).alias("rank"))
    items = first.select(F.col("boost"), "rank", F.lit("dense").alias("mode"), F.lit(False).alias("refused"))
    return retrieval_metrics(items, "boost").drop("mode", "unavailable", "refusal_rate")


def eval_status(questions: DataFrame, log: DataFrame) -> DataFrame:
    """How many generated questions there are, and log rows with at least one positive mark."""
    positive = F.exists(F.map_values("relevant"), lambda v: F.coalesce(v, F.lit(False)))
    labelled = log.agg(F.count_if(F.coalesce(positive, F.lit(False))).alias("labelled"))
    return labelled.select(questions.agg(F.count("*")).scalar().alias("generated"), "labelled")


def latest_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)
