"""Registered queries: incremental catalogue state, remote sync plans, enrichment, vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import chunking as K
from ..operators import enrichment as E
from ..operators import remote as S
from ..operators import vocabulary as V
from .registry import query
from .text_plans import CHUNKS_SQL


def inbox(t):
    """documents as files, a catalogue of an earlier scan (French files changed since), and an exclusion list."""
    d = t.documents
    path = F.concat(F.lit("shelf/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    files = C.with_hash(d.select("doc_id", path.alias("path"), F.col("source").alias("course"), "lang",
                                 F.col("text").cast("binary").alias("content"))).drop("content")
    old = d.filter("lang <> 'es'").select(
        path.alias("path"), F.sha2(F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text")), 256)
        .alias("sha256"), F.when(F.col("lang") == "de", "error").otherwise("ok").alias("status"),
        F.when(F.col("n_chars") < 500, 3).otherwise(4).alias("parser_version"))
    excluded = d.join(t.labels.filter("toxic = 1"), "doc_id").select(path.alias("path"))
    return files, old, excluded


INBOX_SQL = """f AS (SELECT doc_id, 'shelf/' || source || '/' || doc_id || '.txt' AS path, source AS course, lang, text, n_chars FROM documents),
x AS (SELECT path FROM f JOIN labels USING (doc_id) WHERE toxic = 1),
p AS (SELECT f.*, CASE WHEN path IN (SELECT path FROM x) THEN 'excluded' WHEN lang = 'en' AND n_chars >= 500 THEN 'skipped'
   WHEN lang = 'fr' AND n_chars >= 500 AND upper(text) = text THEN 'skipped' ELSE 'ingest' END AS result FROM f)"""


@query("j1_plan_ingest", f"WITH {INBOX_SQL} SELECT doc_id, path, result FROM p")
def j1(t):
    return C.plan_ingest(*inbox(t)).select("doc_id", "path", "result")


@query("j1_forced_counts", f"WITH {INBOX_SQL} SELECT CASE WHEN result = 'skipped' AND course = 'src3' THEN 'ingest' ELSE result END AS result, count(*) AS n FROM p GROUP BY 1")
def j1f(t):
    return C.result_counts(C.plan_ingest(*inbox(t), force=F.col("course") == "src3"))


@query("j2_gone", f"WITH {INBOX_SQL} SELECT path FROM p WHERE lang <> 'es' AND (result = 'excluded' OR course = 'src5')")
def j2(t):
    """The folder src5 vanished from disk."""
    files, old, excluded = inbox(t)
    return C.gone(old, C.plan_ingest(files.filter("course <> 'src5'"), old, excluded)).select("path")


@query("j3_remove_prefix", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
 f AS (SELECT DISTINCT split_part(path, '/', 1) || '/en' AS folder FROM p)
SELECT page_id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE starts_with(p.path, f.folder || '/'))""")
def j3(t):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "")
    pages = t.pages.select("page_id", path.alias("path"))
    folders = pages.select(F.concat(F.element_at(F.split("path", "/"), 1), F.lit("/en")).alias("folder")).distinct()
    return C.remove_prefix(pages, folders).select("page_id", "path")


@query("j4_exclude_include", """
WITH e AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 OR quality = 0)
SELECT 'kept' AS part, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e)
UNION ALL SELECT 'listed', count(*) FROM e
UNION ALL SELECT 'again', (SELECT count(*) FROM e JOIN documents USING (doc_id) WHERE lang = 'en')""")
def j4(t):
    """Exclude bad documents (some already listed), then take the English ones back."""
    cat = t.documents.select(F.col("doc_id").alias("path"), "lang")
    listed = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("path"))
    bad = t.labels.filter("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("path"))
    kept, now = C.exclude(cat, listed, bad)
    _, again = C.include(now, cat.filter("lang = 'en'"))
    parts = [(kept, "kept"), (now, "listed"), (again, "again")]
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for df, name in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def caches(t):
    docs = t.documents.select(F.col("doc_id"), "lang", F.md5("text").alias("sha256"), F.length("text").alias("pages"))
    # a content that documents of both languages hold was parsed by the newer version
    old = docs.filter("lang IN ('fr', 'de')").groupBy("sha256").agg(
        F.max(F.when(F.col("lang") == "fr", 4).otherwise(3)).alias("parser_version"), F.lit(-1).alias("pages"))
    return docs, old


@query("j5_to_parse", "SELECT DISTINCT md5(text) AS sha256 FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'fr')")
def j5(t):
    return C.to_parse(*caches(t)).select("sha256")


@query("j5_page_cache", """
SELECT md5(text) AS sha256, 4 AS parser_version, CASE WHEN max(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) = 1 THEN -1 ELSE max(length(text)) END AS pages
FROM documents WHERE lang <> 'es' GROUP BY 1""")
def j5c(t):
    """New contents are stored, entries of the old parser and of the removed Spanish files are dropped."""
    docs, cache = caches(t)
    new = C.to_parse(docs, cache).select("sha256", F.lit(4).alias("parser_version"), "pages")
    return C.prune_pages(C.store_pages(cache, new), docs.filter("lang <> 'es'")).select(
        "sha256", "parser_version", "pages")


def mirror(t):
    """Orders as remote files; an earlier run knew all but the urgent ones, and some local files were deleted."""
    o, low = t.orders, F.col("o_orderpriority") == "5-LOW"
    target = F.concat(F.lit("o/"), "o_orderkey", F.lit(".pdf"))
    remote = o.select(F.col("o_orderkey").alias("key"), target.alias("target"), F.col("o_orderstatus").alias("modified"),
                      F.when(low, F.col("o_custkey").cast("string")).alias("text_sha"),
                      F.col("o_orderkey").cast("string").alias("content_id"))
    state = o.filter("o_orderpriority <> '1-URGENT'").select(
        F.col("o_orderkey").alias("key"), target.alias("path"),
        F.when(F.col("o_totalprice") > 300000, "F").otherwise(F.col("o_orderstatus")).alias("modified"))
    local = o.filter("o_orderstatus <> 'P'").select(target.alias("path"), F.when(
        F.col("o_totalprice") > 200000, F.col("o_custkey").cast("string")).otherwise("mine").alias("sha"))
    return remote, state, local


SYNC_PLAN_SQL = """a AS (SELECT o_orderkey AS key, o_custkey, o_totalprice, 'o/' || o_orderkey || '.pdf' AS path, CASE
  WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus <> 'P' THEN 'adopt' ELSE 'new' END
  WHEN o_totalprice > 300000 AND o_orderstatus <> 'F' THEN 'changed' WHEN o_orderstatus = 'P' THEN 'deleted_locally'
  WHEN o_orderpriority = '5-LOW' AND o_totalprice <= 200000 THEN 'changed' ELSE 'unchanged' END AS action FROM orders)"""


@query("j6_plan_sync", f"WITH {SYNC_PLAN_SQL} SELECT key, path, action FROM a")
def j6(t):
    return S.plan_sync(*mirror(t)).select("key", "path", "action")


@query("j6_adopt_outcome", f"""WITH {SYNC_PLAN_SQL}
SELECT key, CASE WHEN o_totalprice > 200000 THEN path ELSE 'o/' || key || ' (' || key || ').pdf' END AS path,
       CASE WHEN o_totalprice > 200000 THEN 'already_had' ELSE 'downloaded' END AS outcome FROM a WHERE action = 'adopt'""")
def j6a(t):
    remote, state, local = mirror(t)
    adopted = S.plan_sync(remote, state, local).filter("action = 'adopt'")
    fetched = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("sha"))
    return S.adopt_outcome(adopted, fetched, local).select("key", "path", "outcome")


@query("j7_dedupe_targets", r"""
WITH p AS (SELECT p_partkey, 'mod/' || p_brand || '/' || regexp_replace(regexp_replace(p_name || ': ' || p_type || '?.pdf', '[<>:"/\\|?*]', '-', 'g'), '[. ]+$', '') AS target, p_name FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p_partkey) AS r FROM p)
SELECT p_partkey, CASE WHEN r > 1 OR p_name LIKE 'red %' THEN left(target, length(target) - 4) || ' (' || p_partkey || ').pdf' ELSE target END AS target FROM r""")
def j7(t):
    name = F.concat("p_name", F.lit(": "), "p_type", F.lit("?.pdf"))
    files = t.part.select("p_partkey", "p_name", F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("content_id"),
                          S.target_path(F.lit("mod"), F.array("p_brand"), name).alias("target"))
    claimed = files.filter("p_name LIKE 'red %'").select(F.col("target").alias("path"))
    return S.dedupe_targets(files, claimed).select("p_partkey", "target")


def courses(t):
    """Suppliers as courses named after their nation, with typing errors; nations are the folders."""
    bal, n = F.col("s_acctbal"), F.col("n_name")
    name = (F.when(bal < 1000, F.concat(n, F.lit("__5DS1"))).when(bal < 4000, F.replace(n, F.lit("AT"), F.lit("AAT")))
            .when(bal < 7000, F.lower(n)).otherwise(F.concat(F.lit("x"), F.reverse(n))))
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"), name.alias("name"), "s_name", F.col("s_name").alias("course_id"),
        F.when(bal < 0, "No").when(bal < 5000, "Yes").alias("membership_available"),
        F.when(bal > 9500, "No").alias("course_available"))


def course_folders(t):
    over = t.supplier.filter("s_acctbal > 9000").select(F.col("s_name").alias("key"), F.lit("Special").alias("folder"))
    return S.match_folders(courses(t), t.nation.select(F.col("n_name").alias("folder")), over)


FOLDER_SQL = """c AS (SELECT s_suppkey AS id, s_acctbal AS bal, CASE WHEN s_acctbal < 1000 THEN n_name || '__5DS1' WHEN s_acctbal < 4000 THEN replace(n_name, 'AT', 'AAT')
   WHEN s_acctbal < 7000 THEN lower(n_name) ELSE 'x' || reverse(n_name) END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 k AS (SELECT *, lower(regexp_replace(name, '__[A-Za-z0-9]+$', '')) AS f FROM c),
 z AS (SELECT f, n_name, 1 - levenshtein(f, lower(n_name)) / greatest(length(f), length(n_name)) AS r FROM (SELECT DISTINCT f FROM k), nation),
 b AS (SELECT f, arg_min(n_name, struct_pack(a := -r, b := lower(n_name))) AS near FROM z WHERE r >= 0.85 GROUP BY 1),
 m AS (SELECT k.*, CASE WHEN bal > 9000 THEN 'Special' ELSE near END AS folder FROM k LEFT JOIN b USING (f))"""


@query("j8_match_folders", f"WITH {FOLDER_SQL} SELECT id, name, folder FROM m")
def j8(t):
    return course_folders(t).select("id", "name", "folder")


@query("j9_flatten_tree", """
WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA' AND n_name NOT LIKE '%3')
SELECT 'r' || r_regionkey AS id, '' AS trail, 0 AS depth FROM region WHERE r_name <> 'ASIA'
UNION ALL SELECT 'n' || n_nationkey, r_name, 1 FROM n
UNION ALL SELECT 's' || s_suppkey, r_name || '/' || n_name, 2 FROM n JOIN supplier ON s_nationkey = n_nationkey
UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name, 2 FROM n JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal >= 0""")
def j9(t):
    """Regions, nations, suppliers and customers as one tree; hidden items hide what is below them."""

    def item(df, prefix, key, parent, title, ok):
        up = F.lit(None).cast("string") if parent is None else F.concat(F.lit(parent[0]), F.col(parent[1]))
        return df.select(F.concat(F.lit(prefix), key).alias("id"), up.alias("parent_id"), F.col(title).alias("title"),
                         F.expr(ok).alias("available"))

    tree = (item(t.region, "r", "r_regionkey", None, "r_name", "r_name <> 'ASIA'")
            .unionByName(item(t.nation, "n", "n_nationkey", ("r", "n_regionkey"), "n_name", "n_name NOT LIKE '%3'"))
            .unionByName(item(t.supplier, "s", "s_suppkey", ("n", "s_nationkey"), "s_name", "CAST(NULL AS BOOLEAN)"))
            .unionByName(item(t.customer, "c", "c_custkey", ("n", "c_nationkey"), "c_name", "c_acctbal >= 0")))
    return S.flatten_tree(tree).select("id", F.array_join("folders", "/").alias("trail"), "depth")


@query("j10_latest_by_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def j10(t):
    return S.latest_by_key(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("j11_select_courses", f"WITH {FOLDER_SQL} SELECT id, folder FROM m WHERE bal >= 0 AND bal <= 9500 AND folder IS NOT NULL")
def j11(t):
    return S.select_courses(course_folders(t)).select("id", "folder")


@query("j11_select_one_course", f"WITH {FOLDER_SQL} SELECT id, folder FROM m WHERE bal >= 0 AND bal <= 9500 AND (lower(folder) = 'special' OR (folder IS NOT NULL AND f = 'special'))")
def j11o(t):
    return S.select_courses(course_folders(t), "SPECIAL").select("id", "folder")


# --- enrichment -------------------------------------------------------------------------------------------------------

def doc_chunks(t):
    return K.chunk_pages(t.texts.select("doc_id", F.lit(1).alias("page"), "text"))


@query("k1_token_groups", f"""WITH RECURSIVE {CHUNKS_SQL},
c AS (SELECT doc_id, ord, greatest(1, length(text) // 3) AS n FROM chunk),
g(doc_id, ord, used, group_no) AS (SELECT doc_id, ord, n, 0 FROM c WHERE ord = 0
  UNION ALL SELECT c.doc_id, c.ord, CASE WHEN used + n > 2500 THEN n ELSE used + n END, CASE WHEN used + n > 2500 THEN group_no + 1 ELSE group_no END
  FROM g JOIN c ON c.doc_id = g.doc_id AND c.ord = g.ord + 1)
SELECT doc_id, ord, group_no FROM g""")
def k1(t):
    return K.token_groups(doc_chunks(t))


@query("k1_group_budget", "SELECT o_orderkey AS doc_id, TRUE AS within_budget, count(DISTINCT l_linenumber) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def k1b(t):
    """Invariant over order lines (quantity = tokens, budget 60): a group above the budget is a single item."""
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(
        F.sum("l_quantity").cast("int").alias("n_tokens"))
    g = (K.token_groups(items, 60).join(items, ["doc_id", "ord"]).groupBy("doc_id", "group_no")
         .agg(F.sum("n_tokens").alias("s"), F.count("*").alias("n")))
    return g.groupBy("doc_id").agg(F.bool_and((F.col("s") <= 60) | (F.col("n") == 1)).alias("within_budget"),
                                   F.sum("n").alias("items"))


@query("k2_summarise")
def k2(t):
    return E.summarise(doc_chunks(t)).select("doc_id", F.length("summary").alias("chars"), "calls", "status")


@query("k3_clean_enrichment", r"""
WITH r AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[\p{L}]+[.,]?') AS w FROM conversations),
 s AS (SELECT conv_id, turn, w, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM r),
 c AS (SELECT conv_id, turn, min(i) AS i, lower(x) AS l FROM s GROUP BY conv_id, turn, lower(x)),
 k AS (SELECT conv_id, turn, array_to_string(list(s.x ORDER BY c.i)[1:10], ',') AS concepts, array_to_string(list(l ORDER BY c.i) FILTER (WHERE length(l) <= 40)[1:8], ',') AS tags
       FROM c JOIN s USING (conv_id, turn, i) GROUP BY 1, 2)
SELECT conv_id, turn, CASE WHEN role <> 'system' THEN 'ok' ELSE 'error' END AS status, CASE WHEN role <> 'system' THEN concepts END AS concepts, CASE WHEN role <> 'system' THEN tags END AS tags
FROM conversations LEFT JOIN k USING (conv_id, turn)""")
def k3(t):
    """Every word of a turn is a concept and a tag; system turns come without a summary."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}]+[.,]?"), 0)
    replies = t.conversations.select("conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("summary"),
                                     words.alias("concepts"), words.alias("tags"))
    c = E.clean_enrichment(replies)
    return c.select("conv_id", "turn", "status", F.array_join("concepts", ",").alias("concepts"),
                    F.array_join("tags", ",").alias("tags"))


def enriched(t):
    """documents with enrichment columns from their labels: unrated ones are new, bad ones failed or are unreadable."""
    d = t.documents.join(t.labels, "doc_id", "left")
    sha = F.md5("text")
    return d.select("doc_id", F.col("source").alias("course"), sha.alias("sha256"),
                    F.when(F.col("toxic") == 1, "empty_text").otherwise("ok").alias("status"),
                    F.when(F.col("quality") == 1, sha).when(F.col("quality") == 0, "older").alias("enriched_sha"),
                    F.when(F.col("lang") == "en", "ok").otherwise("error").alias("enrich_status"),
                    (F.lit(0) - F.col("n_chars")).alias("ingested_at"), F.lit("old summary").alias("summary"),
                    F.lit(None).cast("string").alias("enrich_error"))


STATE_SQL = """e AS (SELECT doc_id, source AS course, n_chars, md5(text) AS sha, quality, CASE WHEN toxic = 1 THEN 'skipped' WHEN quality IS DISTINCT FROM 1 THEN 'pending'
  WHEN lang = 'en' THEN 'ok' ELSE 'error' END AS state FROM documents LEFT JOIN labels USING (doc_id))"""


@query("k4_state_counts", f"WITH {STATE_SQL} SELECT s.state, count(e.doc_id) AS n FROM (SELECT unnest(['ok', 'error', 'pending', 'skipped']) AS state) s LEFT JOIN e USING (state) GROUP BY 1")
def k4(t):
    return E.state_counts(enriched(t))


@query("k5_pending", f"WITH {STATE_SQL} SELECT doc_id, course FROM e WHERE state = 'pending'")
def k5(t):
    return E.pending(enriched(t)).select("doc_id", "course")


@query("k6_apply_if_current", f"""WITH {STATE_SQL}
SELECT doc_id, CASE WHEN state = 'pending' AND n_chars < 1000 THEN 'new ' || doc_id ELSE 'old summary' END AS summary,
       state = 'pending' AND n_chars >= 1000 AS still_pending FROM e""")
def k6(t):
    """Results for the whole queue, but longer documents changed while they were summarised."""
    docs = enriched(t)
    sizes = t.documents.select("doc_id", "n_chars")
    results = E.pending(docs).join(sizes, "doc_id").select(
        "doc_id", F.when(F.col("n_chars") < 1000, F.col("sha256")).otherwise("gone").alias("sha256"),
        F.concat(F.lit("new "), "doc_id").alias("summary"), F.lit(None).alias("concepts"), F.lit(None).alias("tags"),
        F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    out = E.enrich_state(E.apply_if_current(docs, results))
    return out.select("doc_id", "summary", (F.col("state") == "pending").alias("still_pending"))


@query("k7_rerun", f"WITH {STATE_SQL} SELECT doc_id, CASE WHEN state IN ('ok', 'error') AND course = 'src4' THEN 'pending' ELSE state END AS state FROM e")
def k7(t):
    return E.enrich_state(E.rerun(enriched(t), course="src4")).select("doc_id", "state")


# --- vocabulary: words of part names by brand -------------------------------------------------------------------------

def _tag_id(brand, word):
    n = F.substring(brand, 7, 3).cast("bigint") * 1_000_000_000
    return n + F.ascii(word) * 1_000_000 + F.ascii(F.substring(word, 2, 1)) * 1_000 + F.ascii(F.substring(word, 3, 1))


def words(t):
    course = F.when(F.col("p_brand") != "Brand#7", F.col("p_brand"))
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), course.alias("course"), F.split("p_name", " ").alias("raw_tags"),
                         F.when(F.col("p_size") > 45, "error").otherwise("ok").alias("enrich_status"))
    seen = t.part.select("p_brand", course.alias("course"), F.explode(F.split("p_name", " ")).alias("raw")).distinct()
    known = seen.filter("raw < 'l' OR raw IN ('old', 'red')")
    tag = F.when(F.col("raw") == "red", _tag_id(F.col("p_brand"), F.lit("blue"))).when(
        F.col("raw") != "old", _tag_id(F.col("p_brand"), F.col("raw")))
    aliases = known.select("course", "raw", tag.alias("tag_id"))
    tags = seen.filter("raw < 'l' OR raw = 'widget'").select(
        _tag_id(F.col("p_brand"), F.col("raw")).alias("tag_id"), "course", F.col("raw").alias("name"),
        (F.col("raw") == "widget").alias("user_named"))
    return docs, aliases, tags


WORDS_SQL = """p AS (SELECT p_partkey AS doc_id, p_brand, CASE WHEN p_brand <> 'Brand#7' THEN p_brand END AS course, string_split(p_name, ' ') AS ws, p_size FROM part),
 r AS (SELECT DISTINCT doc_id, p_brand, course, unnest(ws) AS raw, p_size FROM p),
 ok AS (SELECT * FROM r WHERE p_size <= 45),
 tid AS (SELECT DISTINCT p_brand, course, raw AS name, CAST(substr(p_brand, 7, 3) AS BIGINT) * 1000000000 + ascii(raw) * 1000000 + ascii(substr(raw, 2, 1)) * 1000 + ascii(substr(raw, 3, 1)) AS tag_id FROM r),
 tags AS (SELECT tag_id, p_brand, course, name, name = 'widget' AS user_named FROM tid WHERE name < 'l' OR name = 'widget'),
 al AS (SELECT DISTINCT r.p_brand, r.course, r.raw, CASE WHEN r.raw = 'red' THEN CAST(substr(r.p_brand, 7, 3) AS BIGINT) * 1000000000 + ascii('b') * 1000000 + ascii('l') * 1000 + ascii('u')
        WHEN r.raw <> 'old' THEN tid.tag_id END AS tag_id FROM r JOIN tid ON tid.p_brand = r.p_brand AND tid.name = r.raw WHERE r.raw < 'l' OR r.raw IN ('old', 'red')),
 dt AS (SELECT DISTINCT doc_id, al.tag_id FROM ok JOIN al ON al.p_brand = ok.p_brand AND al.raw = ok.raw WHERE al.tag_id IS NOT NULL)"""


@query("k8_new_raw_tags", f"WITH {WORDS_SQL} SELECT course, raw, count(*) AS freq FROM ok WHERE raw >= 'l' AND raw NOT IN ('old', 'red') GROUP BY 1, 2")
def k8(t):
    docs, aliases, _ = words(t)
    return V.new_raw_tags(docs, aliases)


@query("k9_vocab_pass")
def k9(t):
    """Vectors as raw tags of their label; those with a large first component are known tags already."""
    e = t.embeddings.select("vec_id", F.col("label").cast("string").alias("course"), F.col("embedding").alias("vec"))
    known = F.col("vec")[0] > 0.2
    tags = e.filter(known).select(F.col("vec_id").alias("tag_id"), "course", "vec")
    new = e.filter(~known).select("course", F.col("vec_id").cast("string").alias("raw"),
                                  F.floor(F.abs(F.col("vec")[1]) * 20).alias("freq"), "vec")
    return V.vocab_pass(tags, new, 0.3)


@query("k10_relink", f"WITH {WORDS_SQL} SELECT * FROM dt")
def k10(t):
    docs, aliases, _ = words(t)
    return V.relink(docs, aliases)


@query("k11_prune_tags", f"WITH {WORDS_SQL} SELECT tag_id, course, name FROM tags WHERE user_named OR tag_id IN (SELECT tag_id FROM dt WHERE doc_id IN (SELECT doc_id FROM ok WHERE raw = 'gizmo'))")
def k11(t):
    """Only documents tagged gizmo are left."""
    docs, aliases, tags = words(t)
    left = docs.filter(F.array_contains("raw_tags", "gizmo"))
    return V.prune_tags(tags, V.relink(left, aliases)).select("tag_id", "course", "name")


@query("k12_list_tags", f"""WITH {WORDS_SQL}
SELECT tags.tag_id, tags.course, name, user_named, (SELECT count(*) FROM dt WHERE dt.tag_id = tags.tag_id) AS count,
       coalesce((SELECT string_agg(raw, ',' ORDER BY raw) FROM al WHERE al.tag_id = tags.tag_id AND raw <> tags.name), '') AS raws FROM tags""")
def k12(t):
    docs, aliases, tags = words(t)
    out = V.list_tags(tags, V.relink(docs, aliases), aliases)
    return out.withColumn("raws", F.array_join("raws", ","))


def tag_edits(t):
    _, _, tags = words(t)
    other = tags.select("course", F.col("tag_id").alias("into"), F.col("name").alias("into_name"))
    j = tags.join(other, tags["course"].eqNullSafe(other["course"]), "inner").drop(other["course"])
    merge = j.filter("name = 'gear' AND into_name = 'gizmo'").select(F.lit("merge").alias("op"), "tag_id", "into", F.lit(None).cast("string").alias("name"))
    none = F.lit(None).cast("bigint").alias("into")
    rename = tags.filter("name IN ('cold', 'hot')").select(F.lit("rename").alias("op"), "tag_id", none, F.when(
        F.col("name") == "cold", "  Very  COLD ").otherwise("anvil").alias("name"))
    gone = tags.filter("name = 'bolt'").select(F.lit("delete").alias("op"), "tag_id", none, F.lit(None).cast("string").alias("name"))
    return merge.unionByName(rename).unionByName(gone)


@query("k13_judge_edits", f"""WITH {WORDS_SQL}, v AS (SELECT g.tag_id, 'merge' AS op, 'ok' AS verdict FROM tags g JOIN tags z ON z.p_brand = g.p_brand AND z.name = 'gizmo' WHERE g.name = 'gear'
  UNION ALL SELECT tag_id, 'rename', CASE WHEN name = 'hot' AND p_brand IN (SELECT p_brand FROM tags WHERE name = 'anvil') THEN 'clash' ELSE 'ok' END FROM tags WHERE name IN ('cold', 'hot')
  UNION ALL SELECT tag_id, 'delete', 'ok' FROM tags WHERE name = 'bolt') SELECT * FROM v""")
def k13(t):
    return V.judge_edits(words(t)[2], tag_edits(t)).select("tag_id", "op", "verdict")


@query("k13_apply_tag_edits", f"""WITH {WORDS_SQL},
 b AS (SELECT p_brand, bool_or(name = 'gizmo') AS giz, bool_or(name = 'anvil') AS anv, bool_or(name = 'gear') AS gear, max(CASE WHEN name = 'gizmo' THEN tag_id END) AS giz_id FROM tags GROUP BY 1),
 n AS (SELECT tag_id, course, CASE WHEN name = 'cold' THEN 'very cold' WHEN name = 'hot' AND NOT anv THEN 'anvil' ELSE name END AS name,
       user_named OR name = 'cold' OR (name = 'hot' AND NOT anv) OR (name = 'gizmo' AND gear) AS user_named FROM tags JOIN b USING (p_brand) WHERE NOT (name = 'gear' AND giz) AND name <> 'bolt'),
 a AS (SELECT course, raw, CASE WHEN raw = 'gear' AND giz THEN giz_id WHEN raw = 'bolt' THEN NULL ELSE tag_id END AS tag_id FROM al JOIN b USING (p_brand))
SELECT 'tag' AS part, course, name AS what, tag_id, user_named FROM n UNION ALL SELECT 'alias', course, raw, tag_id, NULL FROM a""")
def k13a(t):
    _, aliases, tags = words(t)
    t2, a2 = V.apply_tag_edits(tags, aliases, tag_edits(t))
    one = t2.select(F.lit("tag").alias("part"), "course", F.col("name").alias("what"), "tag_id", "user_named")
    two = a2.select(F.lit("alias").alias("part"), "course", F.col("raw").alias("what"), "tag_id",
                    F.lit(None).cast("boolean").alias("user_named"))
    return one.unionByName(two)


@query("k14_missed_modules", f"WITH {WORDS_SQL} SELECT DISTINCT course FROM ok WHERE raw >= 'l' AND raw NOT IN ('old', 'red')")
def k14(t):
    docs, aliases, _ = words(t)
    return V.missed_modules(docs, aliases)
