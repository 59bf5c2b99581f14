"""Registered queries: embeddings, nearest neighbours, keyword search, fusion, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import embedding as M
from ..operators import fusion as R
from ..operators import lexical as L
from ..operators import nearest as N
from .registry import query
from .text_plans import STOP_SQL


def vectors(t):
    e = t.embeddings
    return (e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec"), "label"),
            e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label"))


def corpus(t):
    """Questions: all benchmark passages. Chunks: all documents. Each takes the vector whose vec_id is its id modulo
    the number of vectors, so that none is left out where there are fewer vectors."""
    e = t.embeddings.select("vec_id", F.col("embedding").alias("vec"), "label")
    n = F.lit(e.count())
    q = (t.benchmark.join(e, F.pmod("item_id", n) == F.col("vec_id"))
         .select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), "vec", "label",
                 X.keywords(X.nfkc("text")).alias("terms")))
    c = (t.documents.join(e, F.pmod("doc_id", n) == F.col("vec_id"))
         .select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", "vec", "label", "source", "lang"))
    return q, c


PAIRS_SQL = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
"""
CORPUS_SQL = rf"""
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
q AS (SELECT item_id AS question_id, text AS question, vec, label FROM benchmark JOIN v ON vec_id = item_id % (SELECT count(*) FROM v)),
c AS (SELECT doc_id AS chunk_id, text, vec, label, source, lang FROM documents JOIN v ON vec_id = doc_id % (SELECT count(*) FROM v)),
sc AS MATERIALIZED (SELECT question_id, chunk_id, round(list_dot_product(q.vec, c.vec), 6) AS score FROM q, c),
dn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS dense_rank FROM sc QUALIFY dense_rank <= 20),
qt AS (SELECT DISTINCT question_id, term FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+')) AS term FROM q)
       WHERE length(term) > 1 AND term NOT IN ({STOP_SQL})),
ct AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM c) GROUP BY 1, 2),
lm AS MATERIALIZED (SELECT question_id, chunk_id, sum(tf) AS lex_score, count(*) AS n FROM qt JOIN ct USING (term) GROUP BY 1, 2),
lx AS (SELECT question_id, chunk_id, lex_score, n = (SELECT count(*) FROM qt WHERE qt.question_id = lm.question_id) AS all_terms,
              row_number() OVER (PARTITION BY question_id ORDER BY lex_score DESC, chunk_id) AS lex_rank FROM lm QUALIFY lex_rank <= 20),
fu AS (SELECT coalesce(d.question_id, l.question_id) AS question_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id, dense_rank, lex_rank, all_terms,
              round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0), 12) AS rrf
       FROM dn d FULL JOIN lx l ON d.question_id = l.question_id AND d.chunk_id = l.chunk_id),
fr AS MATERIALIZED (SELECT fu.*, sc.score, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, score DESC, chunk_id) AS rank FROM fu JOIN sc USING (question_id, chunk_id))
"""


@query("c1_embed")
def c1(t):
    v = M.embed(t.texts.select("doc_id", "text"))
    return v.select("doc_id", F.size("vec").alias("dim"), F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query("c1_l2_normalize", """
WITH x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda z: z * (1 + label)) AS e FROM embeddings),
     n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM x),
     u AS (SELECT vec_id, unnest(e) / n AS x, generate_subscripts(e, 1) - 1 AS pos FROM n)
SELECT vec_id, pos, round(x, 6) AS x FROM u
""")
def c1n(t):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label")))
    u = t.embeddings.select("vec_id", F.posexplode(V.l2_normalize(scaled)).alias("pos", "x"))
    return u.withColumn("x", F.round("x", 6))


@query("c2_dense_topk", f"""
WITH {PAIRS_SQL} s AS (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, round(list_dot_product(a.vec, b.vec), 6) AS score
                       FROM v a, v b WHERE a.vec_id <> b.vec_id)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20
""")
def c2(t):
    q, c = vectors(t)
    return N.dense_topk(q, c, 20, exclude_self=True)


@query("c2_dense_topk_cells", f"""
WITH {PAIRS_SQL} s AS (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, round(list_dot_product(a.vec, b.vec), 6) AS score
                       FROM v a, v b WHERE a.vec_id <> b.vec_id)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5
""")
def c2c(t):
    """The pruned two-pass form, forced by a small cell size."""
    q, c = vectors(t)
    return N.dense_topk(q, c, 5, exclude_self=True, block=64, cell_size=100)


@query("c3_dense_in_scope", f"""
WITH {PAIRS_SQL} s AS (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, round(list_dot_product(a.vec, b.vec), 6) AS score
                       FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10
""")
def c3(t):
    q, c = vectors(t)
    return N.dense_topk(q, c, 10, scope="label", exclude_self=True)


@query("c4_ann_topk")
def c4(t):
    q, c = vectors(t)
    return N.ann_topk(q, c, 10, n_probe=12, n_cells=16, exclude_self=True)


@query("c4_ann_recall", "SELECT count(*) AS questions, TRUE AS recalled FROM embeddings")
def c4_recall(t):
    """Recall@10 of the approximate search against the exact one, over all vectors as questions: at least 0.9."""
    q, c = vectors(t)
    want = N.dense_topk(q, c, 10, exclude_self=True).select("question_id", "chunk_id")
    hit = want.join(c4(t).select("question_id", "chunk_id", F.lit(1).alias("hit")), ["question_id", "chunk_id"], "left")
    return hit.agg(F.count_distinct("question_id").alias("questions"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recalled"))


def label_summaries(t):
    """One unit vector per label (the mean of its members) in the role of a document summary."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"])
    return means.groupBy("label").agg(V.l2_normalize(vec).alias("vec")).filter("label <> 0")


SUMMARY_SQL = """
p AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v),
m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2),
d0 AS (SELECT label, list(m ORDER BY i) AS vec FROM m WHERE label <> 0 GROUP BY 1),
d AS (SELECT label, list_transform(vec, lambda z: z / sqrt(list_dot_product(vec, vec))) AS vec FROM d0),
"""


@query("c5_doc_boost", f"""
WITH {PAIRS_SQL} {SUMMARY_SQL}
 s AS (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, b.label, round(list_dot_product(a.vec, b.vec), 6) AS score FROM v a, v b WHERE a.vec_id <> b.vec_id),
 t AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS r FROM s QUALIFY r <= 20),
 b AS (SELECT t.question_id, t.chunk_id, t.score, round(coalesce(list_dot_product(v.vec, d.vec), 0), 6) AS doc_score
       FROM t JOIN v ON v.vec_id = t.question_id LEFT JOIN d ON d.label = t.label)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score + 0.2 * doc_score, 6) DESC, score DESC, chunk_id) AS rank FROM b QUALIFY rank <= 5
""")
def c5(t):
    q, c = vectors(t)
    hits = N.dense_topk(q, c, 20, exclude_self=True).join(c.select("chunk_id", "label"), "chunk_id")
    out = N.doc_boost(hits, q, label_summaries(t), 0.2, 5, doc="label")
    return out.select("question_id", "chunk_id", "score", "doc_score", "rank")


@query("c6_embed_missing")
def c6(t):
    """Documents rated good have a current summary; a third of those already carry a vector."""
    d = t.documents.join(t.labels, "doc_id", "left")
    docs = d.select("doc_id", F.md5("text").alias("sha256"), F.md5("text").alias("enriched_sha"),
                    F.when(F.col("quality") == 1, "ok").alias("enrich_status"),
                    F.col("text").alias("summary"),
                    F.when(F.col("toxic") == 1, F.array(F.lit(1.0))).alias("summary_vec"))
    out = M.embed_missing(docs)
    return out.select("doc_id", "enrich_status", F.size("summary_vec").alias("dim"))


@query("d1_postings", r"""
SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2
""")
def d1(t):
    return L.postings(t.documents.select(F.col("doc_id").alias("chunk_id"), "text"))


@query("d2_lexical_topk", rf"""
WITH qt AS (SELECT DISTINCT question_id, term FROM (SELECT conv_id * 1000 + turn AS question_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term
                 FROM conversations WHERE role = 'user') WHERE length(term) > 1 AND term NOT IN ({STOP_SQL})),
 n AS (SELECT question_id, count(*) AS n FROM qt GROUP BY 1),
 ct AS (SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents) GROUP BY 1, 2),
 m AS (SELECT question_id, chunk_id, sum(tf) AS lex_score, count(*) AS hit FROM qt JOIN ct USING (term) GROUP BY 1, 2)
SELECT question_id, chunk_id, CAST(lex_score AS BIGINT) AS lex_score, hit = n AS all_terms,
       row_number() OVER (PARTITION BY question_id ORDER BY lex_score DESC, chunk_id) AS rank FROM m JOIN n USING (question_id) QUALIFY rank <= 20
""")
def d2(t):
    q = t.conversations.filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), X.keywords(X.nfkc("text")).alias("terms"))
    return L.lexical_topk(q, L.block_postings(t.documents.select(F.col("doc_id").alias("chunk_id"), "text")), 20)


def hybrid(t):
    q, c = corpus(t)
    return R.retrieve(q, c, "hybrid", index=L.block_postings(c))


@query("d3_rrf", f"WITH {CORPUS_SQL} SELECT question_id, chunk_id, score, dense_rank, lex_rank, coalesce(all_terms, FALSE) AS all_terms, round(rrf, 9) AS rrf, rank FROM fr")
def d3(t):
    h = hybrid(t)
    return h.select("question_id", "chunk_id", "score", "dense_rank", "lex_rank",
                    F.coalesce("all_terms", F.lit(False)).alias("all_terms"), F.round("rrf", 9).alias("rrf"), "rank")


@query("d4_answerable", f"""WITH {CORPUS_SQL}
SELECT question_id, bool_or(score >= 0.45 OR coalesce(all_terms, FALSE)) AS answerable FROM fr GROUP BY 1""")
def d4(t):
    return R.answerable(hybrid(t), min_score=0.45)


@query("d5_retrieve_dense", f"""WITH {CORPUS_SQL}
SELECT question_id, chunk_id, score, dense_rank AS rank, score >= 0.35 AS used FROM dn WHERE dense_rank <= 5""")
def d5d(t):
    q, c = corpus(t)
    return R.retrieve(q, c, "dense")


@query("d5_retrieve_hybrid", f"""WITH {CORPUS_SQL}
SELECT question_id, chunk_id, rank, rank <= 5 AND bool_or(score >= 0.35 OR coalesce(all_terms, FALSE)) OVER (PARTITION BY question_id) AS used FROM fr""")
def d5h(t):
    return hybrid(t).select("question_id", "chunk_id", "rank", "used")


RERANK_SQL = """
nd AS (SELECT count(*) AS n FROM c),
df AS (SELECT term, count(*) AS df FROM ct GROUP BY 1),
qi AS (SELECT question_id, term, ln(1 + n / (1 + coalesce(df, 0))) AS idf FROM qt LEFT JOIN df USING (term), nd),
tt AS (SELECT question_id, sum(idf) AS total FROM qi GROUP BY 1),
hh AS (SELECT dn.question_id, dn.chunk_id, sum(idf) AS hit FROM dn JOIN qi USING (question_id) JOIN ct ON ct.chunk_id = dn.chunk_id AND ct.term = qi.term GROUP BY 1, 2),
rr AS (SELECT dn.*, round(1 / (1 + exp(-(8 * coalesce(hit, 0) / total - 4))), 9) AS rerank_score FROM dn LEFT JOIN tt USING (question_id) LEFT JOIN hh USING (question_id, chunk_id)),
rk AS (SELECT question_id, chunk_id, score, dense_rank, rerank_score, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, dense_rank) AS rank FROM rr)
"""


def reranked(t, k=None):
    q, c = corpus(t)
    index = L.postings(c)
    n = c.agg(F.count("*").alias("n"))
    return R.retrieve(q, c, "dense", k=k,
                      rerank_with=lambda h: R.rerank(h, R.overlap_logits(h, q, index, n)))


@query("d6_rerank", f"""WITH {CORPUS_SQL}, {RERANK_SQL}
SELECT question_id, chunk_id, score, dense_rank, round(rerank_score, 6) AS rerank_score, rank,
       rank <= 5 AND bool_or(score >= 0.35) OVER (PARTITION BY question_id) AS used FROM rk""")
def d6(t):
    return reranked(t).withColumn("rerank_score", F.round("rerank_score", 6))


@query("d7_build_context", rf"""WITH {CORPUS_SQL}
SELECT question_id, md5(string_agg('[' || dense_rank || '] (doc ' || dn.chunk_id || ', ' || CASE WHEN lang = 'en' THEN 'p. ' || dn.chunk_id WHEN lang = 'fr' THEN 'slide ' || dn.chunk_id
   WHEN lang = 'de' THEN source ELSE 'note' END || ')' || chr(10)
   || CASE WHEN lang = 'es' THEN '' ELSE 'About this file: ' || left(split_part(regexp_replace(regexp_replace(text, '^\s+', ''), '([.!?])\s', '\1' || chr(1)), chr(1), 1), 200) || chr(10) END || text,
   chr(10) || chr(10) ORDER BY dense_rank)) AS context_md5
FROM dn JOIN c USING (chunk_id) WHERE dense_rank <= 5 GROUP BY 1""")
def d7(t):
    q, c = corpus(t)
    hits = N.dense_topk(q, c, 5).join(c.drop("label"), "chunk_id")
    lang = F.col("lang")
    mime = (F.when(lang == "en", X.MIME_BY_EXTENSION["pdf"]).when(lang == "fr", X.MIME_BY_EXTENSION["pptx"])
            .otherwise("text/plain"))
    src = hits.select("question_id", "rank", "text", F.concat(F.lit("doc "), "chunk_id").alias("title"),
                      mime.alias("mime"), F.col("chunk_id").alias("page"),
                      F.when(lang == "de", F.col("source")).alias("label"),
                      F.when(lang != "es", F.col("text")).alias("summary"))
    return R.build_context(src).select("question_id", F.md5("context").alias("context_md5"))


@query("d8_pack_retrieved", f"""WITH {CORPUS_SQL},
 b AS (SELECT question_id, dense_rank AS rank, chunk_id, round(score, 2) AS score, score >= 0.35 AS used FROM dn WHERE dense_rank <= 5)
SELECT question_id, '[' || string_agg('{{"rank":' || rank || ',"chunk_id":' || chunk_id || ',"used":' || used || '}}', ',' ORDER BY rank) || ']' AS retrieved FROM b GROUP BY 1""")
def d8(t):
    q, c = corpus(t)
    packed = R.pack_retrieved(R.retrieve(q, c, "dense"))
    return packed.select("question_id", F.regexp_replace("retrieved", r'"score":[-0-9.E]+,', "").alias("retrieved"))
