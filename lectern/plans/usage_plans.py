"""Registered queries: log analytics, alerts, library browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as R
from ..operators import library as B
from ..operators import lexical as L
from ..operators import usage as U
from .inputs import LOG_SQL, NF_SQL, NOW, query_log
from .registry import query
from .retrieval_plans import CORPUS_SQL, corpus

AFTER = f"ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"


@query("g1_log_summary", f"""WITH {LOG_SQL}
SELECT count(*) AS questions, count(*) FILTER (WHERE answer = {NF_SQL}) AS refused, count(*) FILTER (WHERE citation_valid IS FALSE) AS invalid,
  count(*) FILTER (WHERE answer IS NULL) AS failed, CAST(trunc(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS median_ms, max(latency_ms) AS max_ms FROM log WHERE {AFTER}""")
def g1(t):
    return U.log_summary(query_log(t), 7, NOW)


@query("g1_log_summary_all", f"""WITH {LOG_SQL}
SELECT count(*) AS questions, count(*) FILTER (WHERE answer = {NF_SQL}) AS refused, count(*) FILTER (WHERE citation_valid IS FALSE) AS invalid,
  count(*) FILTER (WHERE answer IS NULL) AS failed, CAST(trunc(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS median_ms, max(latency_ms) AS max_ms FROM log""")
def g1a(t):
    return U.log_summary(query_log(t), 0, NOW)


@query("g2_log_by_module", f"WITH {LOG_SQL} SELECT course, count(*) AS questions, count(*) FILTER (WHERE answer = {NF_SQL}) AS refused FROM log GROUP BY 1")
def g2(t):
    return U.log_by_module(query_log(t), 0, NOW)


DAILY_SQL = f"""{LOG_SQL}, dy AS (SELECT CAST(ts + INTERVAL 1 HOUR AS DATE) AS day, count(*) AS questions,
  CAST(trunc(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS median_ms FROM log WHERE {{0}} GROUP BY 1)"""


@query("g3_log_by_day", f"WITH {DAILY_SQL.format('TRUE')} SELECT CAST(day AS VARCHAR) AS day, questions, median_ms FROM dy")
def g3(t):
    return U.log_by_day(query_log(t), 0, NOW, "Africa/Tunis").withColumn("day", F.col("day").cast("string"))


@query("g4_fill_days", f"""WITH {DAILY_SQL.format(AFTER)}
SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, coalesce(questions, 0) AS questions, median_ms
FROM generate_series(DATE '2024-01-18', DATE '2024-02-02', INTERVAL 1 DAY) g(d) LEFT JOIN dy ON dy.day = CAST(d AS DATE)""")
def g4(t):
    daily = U.log_by_day(query_log(t), 7, NOW, "Africa/Tunis")
    return U.fill_days(daily, "2024-02-02", 16).withColumn("day", F.col("day").cast("string"))


def _problem_sql(cond: str, order: str) -> str:
    return f"WITH {LOG_SQL} SELECT id, question, course, latency_ms FROM log WHERE {cond} AND {AFTER} ORDER BY {order} LIMIT 50"


@query("g5_problems_refused", _problem_sql(f"answer = {NF_SQL}", "id DESC"))
def g5r(t):
    return U.problems(query_log(t), "refused", 7, NOW, 50).drop("ts")


@query("g5_problems_invalid", _problem_sql("citation_valid IS FALSE", "id DESC"))
def g5i(t):
    return U.problems(query_log(t), "invalid", 7, NOW, 50).drop("ts")


@query("g5_problems_slow", _problem_sql("latency_ms IS NOT NULL", "latency_ms DESC, id DESC"))
def g5s(t):
    return U.problems(query_log(t), "slow", 7, NOW, 50).drop("ts")


@query("g6_latest_questions", f"WITH {LOG_SQL} SELECT question, course, max(id) AS id FROM log GROUP BY 1, 2 ORDER BY 3 DESC LIMIT 50")
def g6l(t):
    return U.latest_questions(query_log(t), 50)


@query("g6_compare_modes", f"""WITH {CORPUS_SQL},
d AS (SELECT question_id, chunk_id FROM dn WHERE dense_rank <= 5 AND score >= 0.35),
g AS (SELECT question_id, bool_or(score >= 0.35 OR coalesce(all_terms, FALSE)) AS ok FROM fr GROUP BY 1),
h AS (SELECT question_id, chunk_id FROM fr JOIN g USING (question_id) WHERE ok AND rank <= 5),
o AS (SELECT coalesce(d.question_id, h.question_id) AS question_id, d.chunk_id AS dc, h.chunk_id AS hc FROM d FULL JOIN h ON d.question_id = h.question_id AND d.chunk_id = h.chunk_id)
SELECT q.question_id, CASE WHEN count(dc) > 0 THEN 'answer' ELSE 'refuse' END AS verdict_dense, CASE WHEN count(hc) > 0 THEN 'answer' ELSE 'refuse' END AS verdict_hybrid,
  coalesce(string_agg(CASE WHEN hc IS NULL THEN CAST(dc AS VARCHAR) END, ',' ORDER BY dc), '') AS only_dense,
  coalesce(string_agg(CASE WHEN dc IS NULL THEN CAST(hc AS VARCHAR) END, ',' ORDER BY hc), '') AS only_hybrid,
  coalesce(bool_or(dc IS NULL OR hc IS NULL) FILTER (WHERE o.question_id IS NOT NULL), FALSE) AS changed, (count(dc) > 0) <> (count(hc) > 0) AS flipped
FROM q LEFT JOIN o USING (question_id) GROUP BY 1""")
def g6(t):
    q, c = corpus(t)
    dense = R.retrieve(q, c, "dense")
    hybrid = R.retrieve(q, c, "hybrid", index=L.block_postings(c))
    out = U.compare_modes(q.select("question_id"), dense, hybrid)
    return out.withColumns({k: F.array_join(F.col(k).cast("array<string>"), ",") for k in ("only_dense", "only_hybrid")})


@query("g7_recent_latency", f"""WITH {LOG_SQL}, l AS (SELECT * FROM log WHERE latency_ms IS NOT NULL ORDER BY id DESC LIMIT 20)
SELECT count(*) AS count, CAST(trunc(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS median_ms, max(latency_ms) AS max_ms,
  strftime(arg_max(ts, id), '%Y-%m-%d %H:%M:%S') AS last_at FROM l""")
def g7(t):
    r = U.recent_latency(query_log(t))
    return r.withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query("g8_index_counts", "SELECT (SELECT count(*) FROM orders) AS documents, (SELECT count(*) FROM lineitem) AS chunks, (SELECT count(*) FROM part) AS excluded, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS ocr_chunks")
def g8(t):
    return U.index_counts(t.orders, t.lineitem.select((F.col("l_returnflag") == "R").alias("ocr")), t.part)


def alert_inputs(t):
    """One library per user: what their events say about backups, syncs, files and answers."""
    k, kind, v = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type"), F.col("value")
    g = t.events.groupBy(F.col("user_id").alias("tenant")).agg(
        F.count("*").alias("questions"), F.count_if((kind == "signup") & (v > 20)).alias("invalid"),
        F.count_if(kind == "error").alias("refused"), F.max(F.when((kind == "purchase") & (v > 40), F.col("ts")))
        .alias("backup_at"), F.max(F.when((kind == "view") & (v > 40), F.col("ts"))).alias("last_full_sync"),
        F.count_if((kind == "click") & (v > 150)).alias("problems"), F.count_if(v > 200).alias("summary_errors"),
        F.max_by(k, "event_id").alias("k"))
    return g.select("*", (F.col("k") != 7).alias("services_ok"), (F.col("k") < 8).alias("login_needed"),
                    F.when(F.col("k") < 20, "failed").otherwise("ok").alias("last_sync_state"),
                    F.lit(1).alias("auto_days"), F.when(F.col("k") > 5, "ok").otherwise("failed").alias("status_state"),
                    F.lit("ok").alias("sync_state"), F.when(F.col("k") < 90, "ok").alias("library_state"),
                    F.lit("ok").alias("insights_state"))


ALERT_SQL = f"""i AS (SELECT user_id AS tenant, count(*) AS questions, count(*) FILTER (WHERE event_type = 'signup' AND value > 20) AS invalid,
  count(*) FILTER (WHERE event_type = 'error') AS refused, max(CASE WHEN event_type = 'purchase' AND value > 40 THEN ts END) AS backup_at,
  max(CASE WHEN event_type = 'view' AND value > 40 THEN ts END) AS last_full_sync, count(*) FILTER (WHERE event_type = 'click' AND value > 150) AS problems,
  count(*) FILTER (WHERE value > 200) AS summary_errors, arg_max(CAST(regexp_extract(props, '[0-9]+') AS BIGINT), event_id) AS k FROM events GROUP BY 1),
al AS (SELECT tenant, 'failed:status' AS id, 'warn' AS severity, 'overview' AS tab FROM i WHERE k <= 5
 UNION ALL SELECT tenant, 'services', 'bad', 'overview' FROM i WHERE k > 5 AND k = 7
 UNION ALL SELECT tenant, 'backup', 'warn', 'overview' FROM i WHERE k > 5 AND (backup_at IS NULL OR TIMESTAMP '{NOW}' - backup_at > INTERVAL 2 DAY)
 UNION ALL SELECT tenant, CASE WHEN k < 8 THEN 'sync-login' ELSE 'sync-failed' END, 'bad', 'library' FROM i WHERE k < 20
 UNION ALL SELECT tenant, 'sync-old', 'warn', 'library' FROM i WHERE k >= 20 AND (last_full_sync IS NULL OR TIMESTAMP '{NOW}' - last_full_sync > INTERVAL 3 DAY)
 UNION ALL SELECT tenant, 'unreadable', 'warn', 'library' FROM i WHERE k < 90 AND problems > 0
 UNION ALL SELECT tenant, 'summaries', 'info', 'library' FROM i WHERE k < 90 AND summary_errors > 0
 UNION ALL SELECT tenant, 'invalid', 'warn', 'quality' FROM i WHERE questions >= 10 AND invalid / questions > 0.1
 UNION ALL SELECT tenant, 'refused', 'warn', 'quality' FROM i WHERE questions >= 10 AND refused / questions > 0.25)"""


@query("g9_attention", f"WITH {ALERT_SQL} SELECT * FROM al")
def g9(t):
    return U.attention(alert_inputs(t), NOW).drop("ord")


@query("g10_badge_counts", f"""WITH {ALERT_SQL}, ax AS (SELECT tenant, unnest(['overview','library','quality','settings']) AS tab FROM i)
SELECT ax.tenant, ax.tab, count(al.id) AS n FROM ax LEFT JOIN al ON al.tenant = ax.tenant AND al.tab = ax.tab AND severity <> 'info' GROUP BY 1, 2""")
def g10(t):
    inputs = alert_inputs(t)
    return U.badge_counts(U.attention(inputs, NOW), inputs)


def sync_events(t):
    """events as sync runs, one per user: sign-ups report bytes or end the run, errors carry a message."""
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    return t.events.select(
        F.col("user_id").alias("job"), F.col("event_id").alias("seq"),
        F.when(kind == "signup", F.when(k < 50, "done").otherwise("exit"))
        .when((kind == "error") & (k < 50), "error").otherwise("file").alias("type"),
        F.when(kind == "click", "downloaded").when(kind == "view", "saved_page").when(kind == "purchase", "already_had")
        .when(kind == "error", "failed").alias("action"), F.floor("value").alias("bytes"),
        F.concat(F.lit("broken "), k).alias("message"),
        F.when(k < 70, 0).when(k < 80, 3).otherwise(1).alias("exit_code"), (k >= 95).alias("cancelled"))


SYNC_SQL = """ev AS (SELECT user_id AS job, event_id AS seq, CASE WHEN event_type = 'signup' THEN CASE WHEN k < 50 THEN 'done' ELSE 'exit' END
   WHEN event_type = 'error' AND k < 50 THEN 'error' ELSE 'file' END AS type, event_type, floor(value) AS bytes, k FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)),
 fo AS (SELECT job, count(*) FILTER (WHERE type = 'file' AND event_type = 'click') AS downloaded, count(*) FILTER (WHERE type = 'file' AND event_type = 'view') AS saved_page,
   count(*) FILTER (WHERE type = 'file' AND event_type = 'purchase') AS already_had, 0 AS would_download, 0 AS would_save_page,
   count(*) FILTER (WHERE type = 'file' AND event_type = 'error') AS failed, CAST(coalesce(arg_max(bytes, seq) FILTER (WHERE type = 'done'), 0) AS BIGINT) AS bytes,
   'broken ' || (arg_max(k, seq) FILTER (WHERE type = 'error')) AS error, arg_max(k, seq) FILTER (WHERE type = 'exit') AS xk FROM ev GROUP BY 1)"""


@query("g12_fold_events", f"""WITH {SYNC_SQL}
SELECT * EXCLUDE (xk), CASE WHEN xk < 70 THEN 0 WHEN xk < 80 THEN 3 WHEN xk IS NOT NULL THEN 1 END AS exit_code,
  CASE WHEN xk >= 95 THEN 'cancelled' WHEN xk IS NULL THEN 'running' WHEN xk < 70 THEN 'ok' WHEN xk < 80 THEN 'login_required' ELSE 'failed' END AS state FROM fo""")
def g12(t):
    return U.fold_events(sync_events(t))


@query("g13_last_full", f"""WITH {LOG_SQL} SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_full FROM log WHERE kind <> 'view' AND course IS NULL AND kind = 'click'""")
def g13(t):
    runs = query_log(t).select(F.when(F.col("kind") == "view", "probe").otherwise("sync").alias("mode"), "course",
                               F.when(F.col("kind") == "click", "ok").otherwise("failed").alias("state"),
                               F.col("ts").alias("finished_at"))
    return U.last_full(runs).withColumn("last_full", F.date_format("last_full", "yyyy-MM-dd HH:mm:ss"))


# --- library: orders are documents, line items their chunks, part brands their tags -------------------------------

def shelf(t):
    course = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    docs = t.orders.select(
        F.col("o_orderkey").alias("doc_id"), course.alias("course"), F.concat(F.lit("order "), "o_orderkey").alias("title"),
        F.concat_ws("/", course, F.concat(F.lit("box "), F.col("o_custkey")), F.concat("o_orderkey", F.lit(".pdf"))).alias("path"),
        F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"),
        F.col("o_custkey").cast("string").alias("sha256"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).alias("enriched_sha"),
        F.when(F.col("o_totalprice") > 250000, "error").otherwise("ok").alias("enrich_status"),
        F.col("o_orderstatus").alias("summary"), F.array("o_orderpriority").alias("concepts"),
        F.col("o_orderdate").alias("first_seen"))
    chunks = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey")
    tags = t.part.select(F.substring("p_brand", 7, 3).cast("int").alias("tag_id"), F.col("p_brand").alias("name")).distinct()
    doc_tags = (chunks.join(t.part.select(F.col("p_partkey").alias("l_partkey"),
                                          F.substring("p_brand", 7, 3).cast("int").alias("tag_id")), "l_partkey")
                .select("doc_id", "tag_id").distinct())
    return docs, chunks, doc_tags, tags


SHELF_SQL = """d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS course, 'order ' || o_orderkey AS title,
   concat_ws('/', CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END, 'box ' || o_custkey, o_orderkey || '.pdf') AS path,
   CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status, o_orderstatus AS summary, o_orderdate AS first_seen, o_orderpriority, o_custkey,
   CASE WHEN o_orderstatus = 'P' THEN 'skipped' WHEN o_orderstatus <> 'F' THEN 'pending' WHEN o_totalprice > 250000 THEN 'error' ELSE 'ok' END AS state FROM orders),
 dt AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(substr(p_brand, 7, 3) AS INTEGER) AS tag_id, p_brand AS name FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("h1_document_list", f"""WITH {SHELF_SQL}, n AS (SELECT l_orderkey AS doc_id, count(*) AS chunk_count FROM lineitem GROUP BY 1),
 g AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS tags FROM dt GROUP BY 1)
SELECT doc_id, course, title, state, coalesce(chunk_count, 0) AS chunk_count, coalesce(tags, '') AS tags FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)""")
def h1(t):
    out = B.document_list(*shelf(t))
    return out.select("doc_id", "course", "title", "state", "chunk_count",
                      F.array_join(F.transform("tags", lambda x: x["name"]), ",").alias("tags"))


@query("h2_library_rollup", f"""WITH {SHELF_SQL}
SELECT course, count(DISTINCT d.doc_id) AS documents, count(l_orderkey) AS chunks, count(DISTINCT CASE WHEN status <> 'ok' THEN d.doc_id END) AS problems
FROM d LEFT JOIN lineitem ON l_orderkey = d.doc_id GROUP BY 1""")
def h2(t):
    docs, chunks, _, _ = shelf(t)
    return B.library_rollup(docs, chunks)


@query("h3_library_problems", f"WITH {SHELF_SQL} SELECT doc_id, course, CASE WHEN status <> 'ok' THEN 'unreadable' ELSE 'summary' END AS list FROM d WHERE status <> 'ok' OR state = 'error'")
def h3(t):
    return B.library_problems(shelf(t)[0]).select("doc_id", "course", "list")


@query("h4_courses", f"WITH {SHELF_SQL} SELECT DISTINCT course FROM d WHERE course IS NOT NULL")
def h4(t):
    return B.courses(shelf(t)[0])


@query("h5_filter_library", f"""WITH {SHELF_SQL}
SELECT doc_id, title FROM d WHERE course = '1-URGENT' AND contains(lower(title || ' ' || path || ' ' || summary || ' ' || o_orderpriority), 'box 1')
  AND doc_id IN (SELECT doc_id FROM dt WHERE tag_id IN (2, 5) GROUP BY 1 HAVING count(*) = 2)""")
def h5(t):
    docs, _, doc_tags, _ = shelf(t)
    return B.filter_library(docs, doc_tags, "1-URGENT", " BOX 1", [2, 5]).select("doc_id", "title")


@query("h6_tag_facets", f"WITH {SHELF_SQL} SELECT tag_id, name, count(*) AS n, count(*) >= 2 AS shown FROM dt GROUP BY 1, 2")
def h6(t):
    _, _, doc_tags, tags = shelf(t)
    return B.tag_facets(doc_tags, tags)


@query("h7_group_by_folder", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages),
 s AS (SELECT *, string_split(path, '/') AS x FROM p)
SELECT page_id, x[1] || CASE WHEN len(x) > 2 THEN ' › ' || array_to_string(x[2:len(x)-1], ' › ') ELSE '' END AS folder FROM s""")
def h7(t):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", ""), "/+$", "")
    docs = t.pages.select("page_id", path.alias("path")).withColumn("course", F.element_at(F.split("path", "/"), 1))
    return B.group_by_folder(docs).select("page_id", "folder")


FILED_SQL = f"""{LOG_SQL}, f AS (SELECT id AS doc_id, course, question AS title, ts AS first_seen, kind, ts > TIMESTAMP '2024-01-10 00:00:00' AND kind <> 'view' AS fresh FROM log)"""


def filed(t):
    log = query_log(t)
    docs = log.select(F.col("id").alias("doc_id"), "course", F.col("question").alias("title"), F.col("ts").alias("first_seen"),
                      F.when(F.col("kind") == "error", "error").otherwise("ok").alias("status"))
    return docs, log.filter("kind = 'view'").select(F.col("id").alias("doc_id"))


@query("h8_drawer_counts", f"""WITH {FILED_SQL}, n AS (SELECT course, count(*) AS n, count(*) FILTER (WHERE fresh) AS fresh FROM f WHERE course IS NOT NULL GROUP BY 1),
 k AS (SELECT * FROM (VALUES ('m1', 'modeling'), ('m3', 'data'), ('m77', 'data')) x(course, unit))
SELECT coalesce(n.course, k.course) AS course, coalesce(unit, 'other') AS unit, coalesce(n, 0) AS n, coalesce(fresh, 0) AS fresh FROM n FULL JOIN k ON n.course = k.course""")
def h8(t):
    docs, seen = filed(t)
    known = t.spark.createDataFrame([("m1", "modeling"), ("m3", "data"), ("m77", "data")], "course string, unit string")
    return B.drawer_counts(docs, seen, "2024-01-10 00:00:00", known)


@query("h9_digest", f"""WITH {FILED_SQL}, a AS (SELECT *, bool_or(fresh) OVER (PARTITION BY course) AS any_fresh FROM f WHERE kind <> 'error')
SELECT doc_id, course, fresh, row_number() OVER (PARTITION BY course ORDER BY CASE WHEN fresh THEN title END, first_seen DESC, doc_id) AS pos FROM a WHERE fresh OR NOT any_fresh QUALIFY pos <= 8""")
def h9(t):
    docs, seen = filed(t)
    return B.digest(docs, seen, "2024-01-10 00:00:00").select("doc_id", "course", "fresh", "pos")


@query("h10_newest_filed", "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events")
def h10(t):
    docs, _ = filed(t)
    return B.newest_filed(docs).withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm:ss"))


@query("h11_document_pages", """
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
 l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS tag FROM labels)
SELECT p.doc_id, page, CASE WHEN page = 1 THEN 'first' END AS label, md5(p.text) AS text_md5, coalesce(tag, '') AS tags FROM p LEFT JOIN l USING (doc_id)""")
def h11(t):
    """Every line is a page; copies of a document share one cache entry."""
    d = t.documents.select("doc_id", F.md5("text").alias("sha256"), "text")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        (i + 1).alias("page"), F.when(i == 0, "first").alias("label"), x.alias("text")))
    cache = d.dropDuplicates(["sha256"]).select("sha256", lines.alias("pages"))
    tags = t.spark.createDataFrame([(1, "good"), (0, "bad")], "tag_id int, name string")
    out = B.document_pages(cache, d.select("doc_id", "sha256"), t.labels.select("doc_id", F.col("quality").alias("tag_id")), tags)
    return out.select("doc_id", "page", "label", F.md5("text").alias("text_md5"), F.array_join("tags", ",").alias("tags"))
