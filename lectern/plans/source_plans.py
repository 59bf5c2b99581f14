"""Registered queries: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import pages as P
from ..sources import snapshots as N
from .registry import query

URL_PATH = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query("a1_path_rules", rf"""
WITH p AS (SELECT page_id, CASE WHEN page_id < 100 THEN 'index.MD' ELSE rtrim({URL_PATH}, '/') || '.pdf' END AS path FROM pages)
SELECT page_id, path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS course,
       regexp_replace(split_part(path, '/', -1), '(.)\.[^.]+$', '\1') AS title,
       CASE WHEN lower(path) LIKE '%.pdf' THEN 'application/pdf' ELSE 'text/markdown' END AS mime, TRUE AS supported FROM p
""")
def a1(t):
    url = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "")
    path = F.when(F.col("page_id") < 100, "index.MD").otherwise(
        F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".pdf")))
    return S.path_rules(t.pages.select("page_id", path.alias("path")))


@query("a2_note_titles", r"""
WITH n AS (SELECT doc_id, CASE WHEN lang = 'en' THEN '# ' || source || ' notes' || chr(10) || text ELSE text END AS text,
                  source || '/' || doc_id || CASE WHEN lang = 'fr' THEN '.txt' ELSE '.md' END AS path FROM documents)
SELECT doc_id, CASE WHEN path LIKE '%.md' AND regexp_matches(text, '(?m)^#\s+(.+)$')
                    THEN trim(regexp_extract(text, '(?m)^#\s+(.+)$', 1)) ELSE CAST(doc_id AS VARCHAR) END AS title FROM n
""")
def a2(t):
    d = t.documents
    text = F.when(F.col("lang") == "en", F.concat(F.lit("# "), "source", F.lit(" notes\n"), "text")).otherwise(
        F.col("text"))
    path = F.concat("source", F.lit("/"), "doc_id", F.when(F.col("lang") == "fr", ".txt").otherwise(".md"))
    return d.select("doc_id", S.note_title(text, path).alias("title"))


NOTE_SQL = r"""
WITH b AS (SELECT page_id, html, trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&', 'g')) AS title,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'),
    '(?s)<head>.*?</head>', '', 'g'), '(?s)<script\b.*?</script>', '', 'g'), '(?s)<style\b.*?</style>', '', 'g'),
    '(?s)<nav\b.*?</nav>', '', 'g'), '(?s)<footer\b.*?</footer>', '', 'g') AS h FROM pages),
m AS (SELECT page_id, title, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '[\r\n\t ]+', ' ', 'g'),
    '<h1>\s*(.*?)\s*</h1>', chr(10) || chr(10) || '# \1' || chr(10) || chr(10), 'g'), '(?s)<b>\s*(.*?)\s*</b>', '**\1**', 'g'),
    '<br\s*/?>', chr(10), 'g'), '(?i)</?(?:p|div|ul|ol|table|tr|article|section|blockquote|pre)\b[^>]*>', chr(10) || chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS md FROM b),
u AS (SELECT page_id, title, replace(replace(replace(replace(md, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS md FROM m),
c AS (SELECT page_id, title, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '[ \t]+\n', chr(10), 'g'),
    '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS md FROM u),
k AS (SELECT *, length(regexp_replace(regexp_replace(md, '!?\[[^\]]*\](\(<[^>]*>\))?', '', 'g'), '\s', '', 'g')) AS prose_chars FROM c)
SELECT page_id, title, prose_chars, prose_chars >= 400 AS kept, CASE WHEN prose_chars >= 400 THEN md5('# ' || title || chr(10) || chr(10) || md || chr(10)) END AS note_md5 FROM k
"""


def _notes(t, min_prose: int):
    title = F.trim(F.replace(F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.lit("&amp;"), F.lit("&")))
    n = P.pages_to_notes(t.pages.select("page_id", "html", title.alias("title")), min_prose=min_prose)
    return n.select("page_id", "title", "prose_chars", F.col("note").isNotNull().alias("kept"),
                    F.md5("note").alias("note_md5"))


@query("a3_pages_to_notes", NOTE_SQL)
def a3(t):
    """Threshold 400 instead of 60 so that the drop rule has something to drop in the sample pages."""
    return _notes(t, 400)


@query("a3_all_notes", NOTE_SQL.replace("prose_chars >= 400", "prose_chars >= 60"))
def a3_all(t):
    """With the rule's own threshold of 60."""
    return _notes(t, P.MIN_PROSE)


LINKS_SQL = r"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*>')) AS tag,
                  generate_subscripts(regexp_extract_all(html, '<a [^>]*>'), 1) - 1 AS pos FROM pages),
     l AS (SELECT page_id, pos, regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_extract(tag, 'href="([^"]*)"', 1) AS link FROM a),
     f AS (SELECT *, split_part(regexp_replace(link, '[?#].*$', ''), '/', -1) AS name FROM l),
     x AS (SELECT *, CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN lower(regexp_extract(name, '\.([^.]+)$', 1)) ELSE '' END AS ext FROM f WHERE name <> '')
"""


@query("a4_embedded_files", LINKS_SQL + r"""
SELECT page_id, pos, name, 'url-' || left(sha1(regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1)), 16) AS key, TRUE AS own_host,
       CASE WHEN ext IN ('pdf','pptx','docx','md','txt') THEN 'readable' WHEN ext IN ('png','jpg','jpeg','gif','webp') THEN 'image' ELSE 'skipped' END AS disposition
FROM x
""")
def a4(t):
    return P.embedded_files(t.pages).select("page_id", "pos", "name", "key", "own_host", "disposition")


@query("a5_skipped_by_ext", LINKS_SQL + r"""
SELECT CASE WHEN ext = '' THEN '(no extension)' ELSE '.' || ext END AS ext, count(*) AS n FROM x
WHERE ext NOT IN ('pdf','pptx','docx','md','txt','png','jpg','jpeg','gif','webp') GROUP BY 1
""")
def a5(t):
    return P.skipped_by_ext(P.embedded_files(t.pages))


@query("a6_event_lines", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'log' ELSE 'file' END AS type,
       CASE WHEN event_type <> 'error' THEN event_type END AS action,
       CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS bytes,
       CASE WHEN event_type = 'error' THEN 'boom ' || event_id END AS text FROM events
""")
def a6(t):
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("boom "), "event_id")).otherwise(F.to_json(F.struct(
        F.lit("file").alias("type"), F.col("event_type").alias("action"), F.floor("value").alias("bytes"))))
    return (S.parse_event_lines(t.events.select("event_id", line.alias("value")))
            .select("event_id", "type", "action", "bytes", "text"))


@query("a7_export_tables", """
SELECT 'region' AS "table", CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region
UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation
UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
""")
def a7(t):
    lines = N.export_tables({"region": t.region, "nation": t.nation, "customer": t.customer})
    name = F.coalesce(*[F.get_json_object("value", f"$.row.{c}") for c in ("r_name", "n_name", "c_name")])
    key = F.coalesce(*[F.get_json_object("value", f"$.row.{c}") for c in ("r_regionkey", "n_nationkey", "c_custkey")])
    return lines.select(F.get_json_object("value", "$.table").alias("table"), key.cast("bigint").alias("id"),
                        name.alias("name"))


@query("a8_restore_missing", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
""")
def a8(t):
    """The existing table lost its finished orders and the customers with a negative balance."""
    existing = t.orders.filter("o_orderstatus <> 'F'")
    parents = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return (N.restore_missing(existing, t.orders, "o_orderkey", parents, "o_custkey")
            .select("o_orderkey", "o_custkey"))


@query("a8_restore_from_lines", """
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'
""")
def a8l(t):
    """Export to JSON lines, read back with the table's schema, insert what is missing."""
    lines = N.export_tables({"customer": t.customer, "nation": t.nation})
    back = N.read_backup(lines, "customer", t.customer.schema)
    existing = t.customer.filter("c_mktsegment = 'BUILDING'")
    return N.restore_missing(existing, back, "c_custkey").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("a9_backup_counts", """
SELECT 'region' AS "table", count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation
UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'tags', 0
""")
def a9(t):
    lines = N.export_tables({"region": t.region, "nation": t.nation, "customer": t.customer})
    return N.backup_counts(lines, ["region", "nation", "customer", "tags"])


@query("a10_expired_snapshots", """
WITH m AS (SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M%S') || '-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS name FROM events)
SELECT event_id, name FROM m WHERE name NOT IN (SELECT name FROM m ORDER BY name DESC LIMIT 14)
""")
def a10(t):
    name = F.concat_ws("-", F.date_format("ts", "yyyy-MM-dd_HHmmss"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return N.expired(t.events.select("event_id", name.alias("name")), 14)


@query("a11_upsert_documents", """
SELECT o_orderkey AS id, o_custkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'updated' WHEN o_orderstatus = 'O' THEN 'new' ELSE 'kept' END AS state,
       strftime(CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%Y-%m-%d') AS first_seen FROM orders
""")
def a11(t):
    """Catalogue = orders that are not open; incoming = open ones (new) and finished ones (replaced, first_seen kept)."""
    day = "o_orderdate + INTERVAL 1 DAY"
    current = t.orders.filter("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("path"), F.lit("kept").alias("state"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_seen"))
    incoming = t.orders.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("path"),
        F.when(F.col("o_orderstatus") == "F", "updated").otherwise("new").alias("state"),
        F.date_format(F.expr(day), "yyyy-MM-dd").alias("first_seen"))
    return N.upsert_documents(current, incoming, key="id", keep=("first_seen",))


@query("a11_replace_children", """
SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS version
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' OR l_returnflag <> 'R'
""")
def a11c(t):
    """Finished orders get a new set of lines (their returned lines are gone); the others keep theirs."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    old = lines.withColumn("version", F.lit("old"))
    finished = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    new = lines.filter("l_returnflag <> 'R'").join(finished.hint("shuffle_hash"), "l_orderkey", "left_semi").withColumn(
        "version", F.lit("new"))
    return N.replace_children(old, new, finished, "l_orderkey").drop("l_returnflag")
