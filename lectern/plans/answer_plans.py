"""Registered queries: answers, citations, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import fusion as R
from ..operators import history as H
from ..sources.snapshots import delete_keys
from .inputs import LOG_SQL, MARKED_SQL, NF_SQL, marked_answers, query_log
from .registry import query
from .retrieval_plans import CORPUS_SQL, corpus


@query("e1_validate_citations", f"""WITH {MARKED_SQL},
r AS (SELECT question_id, cited, invalid, replace(replace(replace(replace(answer, '[2]', '<2>'), '[1]', '<1>'), '[3, 9]', '<3>'), '[4]', '<4>') AS s, n_sources
      FROM ma LEFT JOIN od USING (question_id) LEFT JOIN iv USING (question_id)),
x AS (SELECT *, replace(replace(replace(replace(s, '<2>', '[' || coalesce(list_position(cited, 2), 0) || ']'), '<1>', '[' || coalesce(list_position(cited, 1), 0) || ']'),
      '<3>', '[' || coalesce(list_position(cited, 3), 0) || ']'), '<4>', CASE WHEN n_sources = 4 THEN '[' || coalesce(list_position(cited, 4), 0) || ']' ELSE '' END) AS y FROM r)
SELECT question_id, coalesce(array_to_string(cited, ','), '') AS cited, coalesce(array_to_string(invalid, ','), '') AS invalid,
       cited IS NOT NULL AND invalid IS NULL AS valid,
       md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(y, '[ \\t]+([.,;:!?؟،])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+', ''), '\\s+$', '')) AS text_md5 FROM x
""")
def e1(t):
    v = A.validate_citations(marked_answers(t))
    return v.select("question_id", F.array_join("cited", ",").alias("cited"),
                    F.array_join("invalid", ",").alias("invalid"), "valid", F.md5("text").alias("text_md5"))


def order_answers(t):
    """Every order answers from its own lines: line numbers are the source numbers."""
    sizes = t.lineitem.groupBy(F.col("l_orderkey").alias("question_id")).agg(
        F.max("l_linenumber").alias("n_sources"))
    answer = F.concat(F.lit("Ready [2]. Paid [1, 3]. Sent [7] "), "o_orderpriority")
    a = t.orders.select(F.col("o_orderkey").alias("question_id"), answer.alias("answer"))
    sources = t.lineitem.select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rank"),
                                F.col("l_partkey").alias("chunk_id"), F.col("l_returnflag").alias("text"))
    return a.join(sizes, "question_id"), sources


@query("e2_citation_rows", """
WITH n AS (SELECT l_orderkey AS question_id, max(l_linenumber) AS n_sources FROM lineitem GROUP BY 1),
 o AS (SELECT question_id, list_filter([2, 1, 3, 7], lambda x: x <= n_sources) AS cited FROM n JOIN orders ON o_orderkey = question_id),
 r AS (SELECT question_id, unnest(cited) AS rank, generate_subscripts(cited, 1) AS n FROM o)
SELECT question_id, n, rank, l_partkey AS chunk_id, l_returnflag AS snippet FROM r JOIN lineitem ON l_orderkey = question_id AND l_linenumber = rank
""")
def e2(t):
    answers, sources = order_answers(t)
    return (A.citation_rows(A.validate_citations(answers), sources)
            .select("question_id", "n", "rank", "chunk_id", "snippet"))


@query("e3_claims", r"""
WITH a AS (SELECT conv_id, turn, replace(replace(text, '. ', ' [2] [1]. '), ', ', ' [3][3], ') AS answer FROM conversations WHERE role = 'assistant'),
 b AS (SELECT conv_id, turn, unnest(regexp_split_to_array(answer, '\n+')) AS b, generate_subscripts(regexp_split_to_array(answer, '\n+'), 1) - 1 AS block FROM a),
 p AS (SELECT conv_id, turn, block, list_filter(string_split(regexp_replace(b, '(\[\d+\](?:\s*\[\d+\])*[.,;:!?؟،)]*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ps
       FROM b WHERE regexp_matches(b, '\[\d+\]')),
 r AS (SELECT conv_id, turn, block, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS ord FROM p)
SELECT conv_id, turn, block, ord, text, CASE WHEN text LIKE '%[2] [1]%' THEN '2,1' WHEN text LIKE '%[3][3]%' THEN '3' ELSE '' END AS cites FROM r
""")
def e3(t):
    marked = F.replace(F.replace("text", F.lit(". "), F.lit(" [2] [1]. ")), F.lit(", "), F.lit(" [3][3], "))
    a = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", marked.alias("answer"))
    return A.claims(a, ["conv_id", "turn"])


@query("e4_log_rows", f"""WITH {CORPUS_SQL},
u AS (SELECT question_id, count(*) AS n_used, max(CASE WHEN dense_rank = 1 THEN chunk_id END) AS top FROM dn WHERE dense_rank <= 5 AND score >= 0.35 GROUP BY 1)
SELECT q.question_id, CASE WHEN n_used IS NULL THEN {NF_SQL} ELSE 'See [1].' END AS answer,
       CASE WHEN n_used IS NOT NULL THEN n_used >= 1 END AS citation_valid, coalesce(top, -1) AS cited_chunk, 'dense' AS mode
FROM q LEFT JOIN u USING (question_id)""")
def e4(t):
    """Refused questions get the fixed reply and no citations; the others cite their best source."""
    q, c = corpus(t)
    hits = R.retrieve(q, c, "dense")
    used = hits.filter("used")
    raw = used.groupBy("question_id").agg(F.count("*").alias("n_sources")).select(
        "question_id", "n_sources", F.lit("See [1].").alias("answer"), F.lit(5).alias("latency_ms"))
    valid = A.validate_citations(raw)
    cites = A.citation_rows(valid, used.join(c.select("chunk_id", "text"), "chunk_id"))
    rows = A.log_rows(q.select("question_id", "question"), R.pack_retrieved(hits), valid, cites,
                      {"mode": "dense", "top_k": "5"})
    cited = F.coalesce(F.get_json_object("citations", "$[0].chunk_id").cast("bigint"), F.lit(-1))
    return rows.select("question_id", "answer", "citation_valid", cited.alias("cited_chunk"),
                       F.element_at("params", "mode").alias("mode"))


@query("e5_history", f"""WITH {LOG_SQL}
SELECT id, question, answer, latency_ms FROM log WHERE course = 'm3' AND (contains(lower(question), 'by 1') OR contains(lower(answer), 'by 1'))
  AND id < 9000 ORDER BY id DESC LIMIT 500""")
def e5(t):
    return H.history(query_log(t), "m3", "BY 1", 9000, 500).select("id", "question", "answer", "latency_ms")


@query("e6_page_after", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 4321 ORDER BY event_id LIMIT 100")
def e6(t):
    return H.page_after(t.events, "event_id", 4321, 100).select("event_id", "user_id", "event_type")


@query("e7_merge_labels", """
WITH f AS (SELECT l.doc_id, l.quality, l.toxic, d.lang FROM labels l JOIN documents d USING (doc_id))
SELECT doc_id AS id, CASE WHEN lang = 'en' THEN (CASE WHEN toxic = 1 THEN -1 ELSE NULL END) ELSE 1 END AS feedback,
       CASE WHEN lang = 'fr' THEN CASE WHEN quality = 1 THEN '1=true' END
            ELSE CASE WHEN quality = 1 THEN '1=true' ELSE '' END || CASE WHEN quality = 1 THEN ',' ELSE '' END || '2=' || (toxic = 1) END AS relevant FROM f
""")
def e7(t):
    """Marks {1: quality, 2: toxic} with edits: a bad quality mark is cleared, French documents lose mark 2."""
    j = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    m = "map<string,boolean>"
    current = j.select(F.col("doc_id").alias("id"), F.lit(1).alias("feedback"), F.create_map(
        F.lit("1"), F.col("quality") == 1, F.lit("2"), F.col("toxic") == 1).alias("relevant"))
    clear_one = j.filter("quality <> 1").select(
        F.col("doc_id").alias("id"), F.lit(1).alias("seq"), F.lit(False).alias("set_feedback"),
        F.lit(None).cast("int").alias("feedback"),
        F.create_map(F.lit("1"), F.lit(None).cast("boolean")).cast(m).alias("relevant"))
    again = j.select(F.col("doc_id").alias("id"), F.lit(2).alias("seq"), (F.col("lang") == "en").alias("set_feedback"),
                     F.when(F.col("toxic") == 1, -1).alias("feedback"),
                     F.when(F.col("lang") == "fr", F.create_map(F.lit("2"), F.lit(None).cast("boolean")))
                     .otherwise(F.create_map().cast(m)).cast(m).alias("relevant"))
    out = H.merge_labels(current, clear_one.unionByName(again))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("relevant")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("id", "feedback", shown.alias("relevant"))


@query("e8_history_by_day", """
SELECT strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS day, count(*) AS entries, arg_max(event_id, ts) AS newest_id, arg_min(event_id, ts) AS oldest_id
FROM events GROUP BY 1""")
def e8(t):
    h = H.history_by_day(t.events.select(F.col("event_id").alias("id"), "ts"), "Africa/Tunis")
    return h.withColumn("day", F.col("day").cast("string"))


@query("e8_day_groups", f"""WITH {LOG_SQL}, p AS (SELECT * FROM log)
SELECT strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS day, string_agg(CAST(id AS VARCHAR), ',' ORDER BY ts DESC, id DESC) AS ids FROM p GROUP BY 1""")
def e8g(t):
    g = H.day_groups(H.history(query_log(t), limit=None), "Africa/Tunis")
    return g.select(F.col("day").cast("string").alias("day"), F.array_join("ids", ",").alias("ids"))


@query("e9_delete_keys", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def e9(t):
    gone = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return delete_keys(t.orders, gone, "o_custkey").select("o_orderkey", "o_orderstatus")


@query("e10_entry_status", f"""WITH {LOG_SQL}
SELECT id, CASE WHEN answer IS NULL THEN 'error' ELSE 'done' END AS status, coalesce(answer, '') AS text,
       strftime(ts - to_milliseconds(coalesce(latency_ms, 0)), '%Y-%m-%d %H:%M:%S') AS started_at, 0 AS marks FROM log""")
def e10(t):
    s = H.entry_status(query_log(t).withColumn("relevant", F.lit(None).cast("map<string,boolean>")))
    return s.select("id", "status", "text", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
                    F.size("relevant").alias("marks"))
