"""Registered queries: evaluation sets and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import evaluation as E
from ..operators import fusion as R
from ..operators import lexical as L
from ..operators import nearest as N
from .inputs import MARKED_SQL, marked_answers
from ..session import ensure_checkpoint_dir
from .registry import query
from .retrieval_plans import CORPUS_SQL, PAIRS_SQL, RERANK_SQL, SUMMARY_SQL, corpus, label_summaries, vectors
from .text_plans import EN_SQL, FR_SQL

LANG_SQL = f"""CASE WHEN len(list_filter(regexp_extract_all(lower({{0}}), '[a-zà-ÿ]+'), lambda x: x IN ({FR_SQL})))
  + CASE WHEN regexp_matches(lower({{0}}), '{X.FRENCH_ACCENTS}') THEN 2 ELSE 0 END
  > len(list_filter(regexp_extract_all(lower({{0}}), '[a-zà-ÿ]+'), lambda x: x IN ({EN_SQL}))) THEN 'fr' ELSE 'en' END"""
FIRST_SENTENCE_SQL = r"split_part(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '([.!?])\s', '\1' || chr(1)), chr(1), 1)"


@query("f1_page_pool", """
WITH l AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM l WHERE lang <> 'de' AND greatest(1, length(line) // 3) >= 60 QUALIFY r = 1)
SELECT source || '/' || doc_id AS path, source AS course, md5(line) AS text_md5 FROM f WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
""")
def f1(t):
    path = F.concat_ws("/", "source", "doc_id")
    lines = t.documents.select(path.alias("path"), F.lit(1).alias("page"), F.col("source").alias("course"),
                               F.when(F.col("lang") == "de", "error").otherwise("ok").alias("status"),
                               F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    lines = lines.withColumn("n_tokens", X.n_tokens(F.col("text")))
    asked = t.benchmark.join(t.documents, F.col("item_id") == F.col("doc_id")).select(
        path.alias("path"), F.lit(1).alias("page"))
    return E.page_pool(lines, asked).select("path", "course", F.md5("text").alias("text_md5"))


QUOTA_SQL = """
a AS (SELECT *, least({n}, sum(size) OVER ()) AS n, row_number() OVER (ORDER BY size DESC, CAST(course AS VARCHAR)) AS o FROM s),
sl AS (SELECT o, n, row_number() OVER (ORDER BY r, o) AS slot FROM a, (SELECT unnest([1,2,3,4,5]) AS r) WHERE r <= size),
b AS (SELECT a.*, (SELECT count(*) FROM sl WHERE sl.o = a.o AND slot <= a.n) AS q0 FROM a),
c AS (SELECT *, n - sum(q0) OVER () AS l, size - q0 AS cap FROM b),
d AS (SELECT *, CASE WHEN l > 0 THEN l * cap / sum(cap) OVER () ELSE 0 END AS share FROM c),
e AS (SELECT *, q0 + least(cap, floor(share)) AS q1 FROM d),
f AS (SELECT *, n - sum(q1) OVER () AS short, sum(CASE WHEN q1 < size THEN 1 ELSE 0 END) OVER (ORDER BY share - floor(share) DESC, o) AS turn FROM e),
g AS (SELECT *, q1 + CASE WHEN q1 < size AND turn <= short THEN 1 ELSE 0 END AS q2 FROM f),
h AS (SELECT *, n - sum(q2) OVER () AS short2, coalesce(sum(size - q2) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM g),
quota AS (SELECT course, size, CAST(q2 + greatest(0, least(size - q2, short2 - ahead)) AS BIGINT) AS quota FROM h)
"""


@query("f2_quotas", f"WITH s AS (SELECT source AS course, count(*) AS size FROM documents GROUP BY 1), {QUOTA_SQL.format(n=150)} SELECT * FROM quota")
def f2(t):
    return E.quotas(t.documents.groupBy(F.col("source").alias("course")).agg(F.count("*").alias("size")), 150)


@query("f2_quotas_uneven", f"WITH s AS (SELECT o_custkey AS course, count(*) AS size FROM orders GROUP BY 1), {QUOTA_SQL.format(n=9000)} SELECT * FROM quota")
def f2u(t):
    return E.quotas(t.orders.groupBy(F.col("o_custkey").alias("course")).agg(F.count("*").alias("size")), 9000)


@query("f3_stratified_sample", f"""WITH s AS (SELECT source AS course, count(*) AS size FROM documents GROUP BY 1), {QUOTA_SQL.format(n=150)}
SELECT doc_id, d.source AS course FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':1'), doc_id) AS r FROM documents) d
JOIN quota ON course = d.source WHERE r <= quota""")
def f3(t):
    pool = t.documents.select("doc_id", F.col("source").alias("course"))
    sizes = pool.groupBy("course").agg(F.count("*").alias("size"))
    return E.stratified_sample(pool, E.quotas(sizes, 150), 150, F.col("doc_id"), 1)


def question_pairs(t):
    """(first sentence of a user turn, passage): the passage is the turn itself when it is long, else the reply."""
    u = t.conversations.filter("role = 'user'").select("conv_id", "turn", "text")
    a = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                           F.col("text").alias("reply"))
    passage = F.when(F.length("text") > 300, F.col("text")).otherwise(F.col("reply"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", X.first_sentence(F.col("text"), None).alias("question"),
                                                 passage.alias("passage"))


PAIR_SQL = rf"""
pq AS (SELECT u.conv_id, u.turn, {FIRST_SENTENCE_SQL.format('u.text')} AS question, CASE WHEN length(u.text) > 300 THEN u.text ELSE a.text END AS passage
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
tk AS (SELECT *, regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+') AS qw, regexp_extract_all(lower(passage), '[\p{{L}}\p{{N}}_]+') AS pw,
      len(list_filter(regexp_split_to_array(question, '\s+'), lambda w: w <> '')) AS n FROM pq),
jd AS (SELECT conv_id, turn, question, passage, CASE WHEN n = 0 THEN 'empty' WHEN n < 4 THEN 'too short' WHEN n > 40 THEN 'too long'
      WHEN list_has_any(list_transform(range(1, len(qw) - 3), lambda i: array_to_string(qw[i:i+4], ' ')), list_transform(range(1, len(pw) - 3), lambda i: array_to_string(pw[i:i+4], ' ')))
      THEN 'copies the passage' END AS reason FROM tk)
"""


@query("f4_reject_reason", f"WITH {PAIR_SQL} SELECT conv_id, turn, reason FROM jd")
def f4(t):
    return question_pairs(t).select("conv_id", "turn", E.reject_reason(F.col("question"), F.col("passage"))
                                    .alias("reason"))


@query("f4_shared_ngrams", r"""
WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a)),
 b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
 h AS (SELECT DISTINCT array_to_string(w[i:i+4], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 3)) AS i FROM b))
SELECT doc_id, count(*) AS n_shared FROM g WHERE g IN (SELECT g FROM h) GROUP BY 1
""")
def f4s(t):
    return E.shared_ngrams(t.texts.select("doc_id", "text"), t.benchmark, "doc_id")


@query("f5_accept_questions", f"""WITH {PAIR_SQL},
 g AS (SELECT conv_id AS path, min(turn) AS turn FROM jd WHERE reason IS NULL GROUP BY 1)
SELECT 'accepted' AS outcome, count(*) AS n FROM g WHERE path NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')
UNION ALL SELECT reason, count(*) FROM jd WHERE reason IS NOT NULL GROUP BY 1""")
def f5(t):
    """One page per conversation, so only the earliest usable question of each is taken."""
    cand = question_pairs(t).select(F.col("turn").alias("id"), F.col("conv_id").alias("path"),
                                    F.lit(1).alias("page"), "question", "passage")
    have = t.conversations.filter("role = 'system'").select(F.col("conv_id").alias("path"), F.lit(1).alias("page"))
    fresh, reasons = E.accept_questions(have, cand)
    taken = fresh.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("outcome"), "n")
    return taken.unionByName(reasons.select(F.col("reason").alias("outcome"), "n"))


@query("f6_truth_set", f"""
SELECT 'generated' AS source, item_id AS id, NULL AS course, {LANG_SQL.format('text')} AS lang, 'bench/' || item_id AS path, CAST(1 AS BIGINT) AS page FROM benchmark
UNION ALL SELECT 'real', doc_id, d.source, {LANG_SQL.format(FIRST_SENTENCE_SQL.format('text'))}, d.source || '/' || doc_id, 1 FROM documents d JOIN labels USING (doc_id) WHERE quality = 1
UNION ALL SELECT 'real', doc_id, d.source, {LANG_SQL.format(FIRST_SENTENCE_SQL.format('text'))}, 'toxic', 2 FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1
""")
def f6(t):
    made = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"),
                              F.lit(None).cast("string").alias("course"), X.detect_lang(F.col("text")).alias("lang"),
                              F.concat(F.lit("bench/"), "item_id").alias("path"), F.lit(1).cast("bigint").alias("page"))
    d = t.documents.join(t.labels, "doc_id")
    one = F.lit(1).cast("bigint")
    cites = F.array(F.struct(F.lit(1).alias("n"), F.concat_ws("/", "source", "doc_id").alias("path"), one.alias("page")),
                    F.struct(F.lit(2).alias("n"), F.lit("toxic").alias("path"), (one + 1).alias("page")))
    log = d.select(F.col("doc_id").alias("id"), X.first_sentence(F.col("text"), None).alias("question"),
                   F.col("source").alias("course"), cites.alias("citations"),
                   F.create_map(F.lit("1"), F.col("quality") == 1, F.lit("2"), F.col("toxic") == 1).alias("relevant"))
    return E.truth_set(made, log).drop("question")


def dense_ranks(t) -> DataFrame:
    """Every vector asks for the others; a hit with its own label is right."""
    q, c = vectors(t)
    hits = N.dense_topk(q, c, 20, exclude_self=True).join(c.select("chunk_id", "label"), "chunk_id")
    return E.first_rank(q.select("question_id", "label"), hits, q.select("question_id", "label"),
                        ["question_id", "label"])


RANKS_SQL = f"""{PAIRS_SQL} s AS (SELECT a.vec_id AS question_id, a.label, b.label AS found, round(list_dot_product(a.vec, b.vec), 6) AS score, b.vec_id AS chunk_id
       FROM v a, v b WHERE a.vec_id <> b.vec_id),
 t AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS r FROM s QUALIFY r <= 20),
 ranks AS (SELECT question_id, any_value(label) AS label, min(CASE WHEN label = found THEN r END) AS rank FROM t GROUP BY 1)"""
RATES_SQL = """round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5,
 round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6) AS recall_20, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr,
 round(avg(CASE WHEN refused THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in E.RATES})


@query("f7_first_rank", f"WITH {RANKS_SQL} SELECT question_id, label, rank FROM ranks")
def f7(t):
    return dense_ranks(t)


@query("f8_retrieval_metrics", f"WITH {RANKS_SQL} SELECT 'dense' AS mode, count(*) AS n, {RATES_SQL}, FALSE AS unavailable FROM (SELECT *, FALSE AS refused FROM ranks)")
def f8(t):
    items = dense_ranks(t).withColumns({"mode": F.lit("dense"), "refused": F.lit(False)})
    return rounded(E.retrieval_metrics(items))


def evaluation_items(t) -> DataFrame:
    """One row per (question, mode): the three retrieval modes over the corpus, 20 deep. They share one vector search."""
    ensure_checkpoint_dir(t.spark)
    q, c = corpus(t)
    index = L.block_postings(c)
    dense = N.dense_topk(q, c, 20).checkpoint()
    n = c.agg(F.count("*").alias("n"))
    modes = {
        "dense": R.retrieve(q, c, "dense", k=20, dense=dense),
        "hybrid": R.retrieve(q, c, "hybrid", index=index, dense=dense),
        "dense+rerank": R.retrieve(q, c, "dense", k=20, dense=dense,
                                   rerank_with=lambda h: R.rerank(h, R.overlap_logits(h, q, L.postings(c), n))),
    }
    info = q.select("question_id", F.col("label").alias("course"), X.detect_lang(F.col("question")).alias("lang"),
                    F.lit("generated").alias("source"), "label")
    label = c.select("chunk_id", "label")

    def items(mode: str, hits: DataFrame) -> DataFrame:
        ranked = E.first_rank(info, hits.select("question_id", "chunk_id", "rank").join(label, "chunk_id"),
                              info.select("question_id", "label"), ["question_id", "label"])
        used = hits.filter("used").select("question_id").distinct().withColumn("_u", F.lit(True))
        return (ranked.join(used, "question_id", "left").withColumn("refused", F.col("_u").isNull())
                .withColumn("mode", F.lit(mode)).drop("_u"))

    return reduce(DataFrame.unionByName, [items(m, h) for m, h in modes.items()])


@query("f9_metrics_by", f"""WITH {CORPUS_SQL}, {RERANK_SQL},
h AS (SELECT 'dense' AS mode, question_id, chunk_id, dense_rank AS rank, score >= 0.35 AS ok FROM dn
      UNION ALL SELECT 'hybrid', question_id, chunk_id, rank, score >= 0.35 OR coalesce(all_terms, FALSE) FROM fr
      UNION ALL SELECT 'dense+rerank', question_id, chunk_id, rank, score >= 0.35 FROM rk),
i AS (SELECT m.mode, q.question_id, q.label AS course, {LANG_SQL.format('question')} AS lang, 'generated' AS source,
      min(CASE WHEN c.label = q.label AND h.rank <= 20 THEN h.rank END) AS rank, NOT coalesce(bool_or(h.ok), FALSE) AS refused
      FROM q CROSS JOIN (SELECT unnest(['dense', 'hybrid', 'dense+rerank']) AS mode) m LEFT JOIN h ON h.mode = m.mode AND h.question_id = q.question_id
      LEFT JOIN c ON c.chunk_id = h.chunk_id GROUP BY 1, 2, 3, 4, 5)
SELECT mode, CASE WHEN grouping(course) = 0 THEN 'course' WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS breakdown,
       CASE WHEN grouping(course) = 0 THEN CAST(course AS VARCHAR) WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source END AS value,
       count(*) AS n, {RATES_SQL}, FALSE AS unavailable
FROM i GROUP BY GROUPING SETS ((mode), (mode, course), (mode, lang), (mode, source))""")
def f9(t):
    return rounded(E.metrics_by(evaluation_items(t)))


@query("f10_unavailable_mode", f"""WITH {RANKS_SQL}
SELECT 'dense' AS mode, count(*) AS n, {RATES_SQL}, FALSE AS unavailable FROM (SELECT *, FALSE AS refused FROM ranks)
UNION ALL SELECT 'dense+rerank', 0, NULL, NULL, NULL, NULL, NULL, TRUE""")
def f10(t):
    """The reranked mode could not be run for questions of label 3."""
    items = dense_ranks(t).withColumns({"mode": F.lit("dense"), "refused": F.lit(False), "available": F.lit(True)})
    other = items.withColumn("mode", F.lit("dense+rerank")).withColumn(
        "available", F.when(F.col("label") != 3, True))
    return rounded(E.retrieval_metrics(items.unionByName(other)))


@query("f11_answer_metrics", f"""WITH {MARKED_SQL},
a AS (SELECT ma.question_id, ms, ms < 80 AS refused, cited IS NOT NULL AND invalid IS NULL AS valid, coalesce(list_contains(cited, 4), FALSE) AS cited_right
      FROM ma LEFT JOIN od USING (question_id) LEFT JOIN iv USING (question_id))
SELECT count(*) AS n, round(avg(CASE WHEN refused THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate, round(avg(CASE WHEN NOT refused THEN CASE WHEN valid THEN 1.0 ELSE 0.0 END END), 6) AS citation_valid_rate,
  round(avg(CASE WHEN NOT refused THEN CASE WHEN cited_right THEN 1.0 ELSE 0.0 END END), 6) AS cited_right_rate,
  CAST(trunc(quantile_cont(CASE WHEN NOT refused THEN ms END, 0.5)) AS BIGINT) AS median_ms FROM a""")
def f11(t):
    """Answers to short replies count as refused; source 4 is the right page of every question."""
    v = A.validate_citations(marked_answers(t))
    refs = v.select("question_id", F.explode("cited").alias("page"))
    truth = v.select("question_id", F.lit(4).cast("bigint").alias("page"))
    right = E.cited_right(refs, truth, ["question_id", "page"]).withColumn("cited_right", F.lit(True))
    items = v.join(right, "question_id", "left").withColumn("refused", F.col("ms") < 80)
    m = E.answer_metrics(items)
    return m.withColumns({c: F.round(c, 6) for c in ("refusal_rate", "citation_valid_rate", "cited_right_rate")})


def daily_runs(t) -> DataFrame:
    """One evaluation run per day and event type, its recall being the share of quick events."""
    return t.events.groupBy(F.unix_date(F.to_date("ts")).alias("id"), F.col("event_type").alias("kind")).agg(
        F.round(F.avg(F.when(F.col("value") < 20, 1.0).otherwise(0.0)), 4).alias("recall_5"))


RUNS_SQL = """r AS (SELECT datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS id, event_type AS kind,
  round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END), 4) AS recall_5 FROM events GROUP BY 1, 2)"""


@query("f12_run_deltas", f"WITH {RUNS_SQL} SELECT id, kind, recall_5, CAST(floor((recall_5 - lag(recall_5) OVER (PARTITION BY kind ORDER BY id)) * 100 + 0.5) AS BIGINT) AS delta_points FROM r")
def f12(t):
    return E.run_deltas(daily_runs(t))


@query("f12_best_modes", f"""WITH {RUNS_SQL}, v AS (SELECT id, kind AS mode, recall_5 AS value, id < 19740 AS lower FROM r)
SELECT id, mode, value, lower, count(value) OVER w >= 2 AND min(value) OVER w < max(value) OVER w AND value = CASE WHEN lower THEN min(value) OVER w ELSE max(value) OVER w END AS is_best
FROM v WINDOW w AS (PARTITION BY id)""")
def f12b(t):
    v = daily_runs(t).select("id", F.col("kind").alias("mode"), F.col("recall_5").alias("value"),
                             (F.col("id") < 19740).alias("lower"))
    return E.best_modes(v, ["id"])


@query("f13_sweep", f"""WITH {PAIRS_SQL} {SUMMARY_SQL}
 s AS (SELECT a.vec_id AS question_id, a.label AS want, b.vec_id AS chunk_id, b.label, round(list_dot_product(a.vec, b.vec), 6) AS score FROM v a, v b WHERE a.vec_id <> b.vec_id),
 t AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS r FROM s QUALIFY r <= 20),
 b AS (SELECT t.*, round(coalesce(list_dot_product(v.vec, d.vec), 0), 6) AS doc_score FROM t JOIN v ON v.vec_id = t.question_id LEFT JOIN d ON d.label = t.label),
 g AS (SELECT *, unnest([0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS boost FROM b),
 k AS (SELECT *, row_number() OVER (PARTITION BY boost, question_id ORDER BY round(score + boost * doc_score, 6) DESC, score DESC, chunk_id) AS rr FROM g),
 i AS (SELECT boost, question_id, min(CASE WHEN label = want THEN rr END) AS rank, FALSE AS refused FROM k GROUP BY 1, 2)
SELECT boost, count(*) AS n, {RATES_SQL} FROM i GROUP BY 1""")
def f13(t):
    q, c = vectors(t)
    hits = N.dense_topk(q, c, 20, exclude_self=True).join(c.select("chunk_id", "label"), "chunk_id")
    s = E.sweep(hits, q, label_summaries(t), "label", [0, 0.1, 0.2, 0.3], doc="label")
    return rounded(s.withColumn("refusal_rate", F.lit(0.0)))


@query("f14_eval_status", "SELECT (SELECT count(*) FROM benchmark) AS generated, (SELECT count(*) FROM labels WHERE quality = 1 OR toxic = 1) AS labelled")
def f14(t):
    log = t.labels.select(F.create_map(F.lit("1"), F.col("quality") == 1, F.lit("2"), F.col("toxic") == 1)
                          .alias("relevant"))
    return E.eval_status(t.benchmark, log)


@query("f14_latest_runs", f"WITH {RUNS_SQL}, k AS (SELECT id * 10 + length(kind) AS id, kind, recall_5 FROM r WHERE kind <> 'error') SELECT * FROM k ORDER BY id DESC LIMIT 10")
def f14r(t):
    runs = daily_runs(t).filter("kind <> 'error'").withColumn("id", F.col("id") * 10 + F.length("kind"))
    return E.latest_runs(runs)
