"""Registered queries: calendar tables and one-line captures. Orders are the items, their shipping the end."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import capture as P
from .registry import query

NOW = "1998-06-15 12:00:00"


def items(t):
    price, pri, st = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")
    ends = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").cast("timestamp_ntz").alias("ship"))
    kind = F.when(pri.isin("1-URGENT", "2-HIGH"), "event").when(pri == "5-LOW", "note").otherwise("todo")
    o = t.orders.select(F.col("o_orderkey").alias("id"), kind.alias("kind"), "o_orderdate", st.alias("st"), price.alias("price"), pri.alias("pri"), "o_custkey")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return o.join(ends, "id", "left").select(
        "id", "kind", F.when((F.col("st") == "P") & (F.col("kind") == "todo"), "").otherwise(F.concat(F.lit("order "), "id")).alias("title"),
        F.concat_ws(" ", "st", "pri").alias("body"), F.when(F.col("pri") != "4-NOT SPECIFIED", F.col("pri")).alias("course"),
        F.when((F.col("kind") != "note") | (F.col("st") == "P"), day).alias("starts_at"),
        F.when((F.col("kind") == "event") | (F.col("price") > 400000), F.col("ship")).alias("ends_at"),
        (F.col("st") == "F").alias("all_day"), F.when(F.col("price") < 30000, day + F.expr("INTERVAL 1 DAY")).alias("done_at"),
        F.when(F.col("price") > 100000, "feed").otherwise("me").alias("source"), F.col("id").cast("string").alias("source_id"),
        F.when(F.col("price") > 350000, day).alias("removed_at"),
        F.when((F.col("kind") == "note") & (F.col("price") < 60000), "notes/x.md").alias("filed_path"), day.alias("created_at"))


ITEMS_SQL = """sh AS (SELECT l_orderkey AS id, max(l_shipdate) AS ship FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'event' WHEN o_orderpriority = '5-LOW' THEN 'note' ELSE 'todo' END AS kind,
  o_orderdate AS d, o_orderstatus AS st, o_totalprice AS price, o_orderpriority AS pri FROM orders),
it AS (SELECT o.id, kind, CASE WHEN st = 'P' AND kind = 'todo' THEN '' ELSE 'order ' || o.id END AS title, st || ' ' || pri AS body, CASE WHEN pri <> '4-NOT SPECIFIED' THEN pri END AS course,
  CASE WHEN kind <> 'note' OR st = 'P' THEN d END AS starts_at, CASE WHEN kind = 'event' OR price > 400000 THEN ship END AS ends_at, st = 'F' AS all_day,
  CASE WHEN price < 30000 THEN d + INTERVAL 1 DAY END AS done_at, CASE WHEN price > 100000 THEN 'feed' ELSE 'me' END AS source, CASE WHEN price > 350000 THEN d END AS removed_at,
  CASE WHEN kind = 'note' AND price < 60000 THEN 'notes/x.md' END AS filed_path, d AS created_at FROM o LEFT JOIN sh USING (id)),
ie AS (SELECT *, coalesce(ends_at, starts_at + CASE WHEN all_day THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END) AS fin FROM it)"""
LATE_SQL = f"(kind = 'todo' AND done_at IS NULL AND removed_at IS NULL AND starts_at IS NOT NULL AND starts_at < TIMESTAMP '{NOW}')"


@query("i1_audit_items", f"""WITH {ITEMS_SQL}
SELECT id, 'title_needed' AS rule, 'a to-do or event needs a title' AS message FROM it WHERE kind <> 'note' AND title = ''
UNION ALL SELECT id, 'note_undated', 'a note has no date' FROM it WHERE kind = 'note' AND starts_at IS NOT NULL
UNION ALL SELECT id, 'no_done_events', 'events can''t be done' FROM it WHERE kind = 'event' AND done_at IS NOT NULL
UNION ALL SELECT id, 'end_on_events', 'only events have an end' FROM it WHERE kind <> 'event' AND ends_at IS NOT NULL
UNION ALL SELECT id, 'event_start', 'an event needs a start' FROM it WHERE kind = 'event' AND starts_at IS NULL
UNION ALL SELECT id, 'end_after_start', 'the end is before the start' FROM it WHERE ends_at < starts_at""")
def i1(t):
    return C.audit_items(items(t))


LIST_SQL = f"""WITH {ITEMS_SQL}
SELECT id, title FROM ie WHERE kind = 'event' AND course = '1-URGENT' AND fin >= TIMESTAMP '1998-01-01' AND starts_at < TIMESTAMP '1999-01-01'
  AND (contains(lower(title), 'order 1') OR contains(lower(body), 'order 1')) AND done_at IS NULL ORDER BY starts_at, created_at DESC, id DESC LIMIT 1000"""
UNDATED_SQL = f"WITH {ITEMS_SQL} SELECT id, kind FROM ie WHERE contains(lower(title), 'order 7') ORDER BY starts_at NULLS LAST, created_at DESC, id DESC LIMIT 1000"


def urgent(t, limit: int | None = None):
    return C.list_items(items(t), "event", "1-URGENT", "1998-01-01", "1999-01-01", "ORDER 1", True, limit).select("id", "title")


@query("i2_list_items", LIST_SQL)
def i2(t):
    """One list of a thousand items, as its SQL has it; i2_list_all_items has them all."""
    return urgent(t, 1000)


@query("i2_list_all_items", LIST_SQL.replace(" LIMIT 1000", ""))
def i2_all(t):
    return urgent(t)


@query("i2_list_items_undated", UNDATED_SQL)
def i2u(t):
    """One list of a thousand items, as its SQL has it; i2_list_all_undated has them all."""
    return C.list_items(items(t), q="order 7", limit=1000).select("id", "kind")


@query("i2_list_all_undated", UNDATED_SQL.replace(" LIMIT 1000", ""))
def i2u_all(t):
    return C.list_items(items(t), q="order 7").select("id", "kind")


@query("i3_overlap_join", f"""WITH {ITEMS_SQL}, w AS (SELECT DISTINCT date_trunc('month', d) AS w_start, date_trunc('month', d) + INTERVAL 1 MONTH AS w_end FROM o)
SELECT strftime(w_start, '%Y-%m') AS month, id FROM ie, w WHERE fin >= starts_at AND fin >= w_start AND starts_at < w_end""")
def i3(t):
    i = items(t)
    month = F.trunc(F.to_date("created_at"), "month")
    w = i.select(month.cast("timestamp_ntz").alias("w_start"), F.add_months(month, 1).cast("timestamp_ntz").alias("w_end")).distinct()
    return C.overlap_join(i, w).select(F.date_format("w_start", "yyyy-MM").alias("month"), "id")


@query("i4_upcoming", f"""WITH {ITEMS_SQL}
SELECT id, kind FROM ie WHERE starts_at IS NOT NULL AND done_at IS NULL AND removed_at IS NULL
  AND ((kind = 'todo' AND starts_at < TIMESTAMP '{NOW}') OR (fin >= TIMESTAMP '{NOW}' AND starts_at < TIMESTAMP '{NOW}' + INTERVAL 7 DAY))""")
def i4(t):
    return C.upcoming(items(t), NOW).select("id", "kind")


@query("i5_overdue", f"WITH {ITEMS_SQL} SELECT id, {LATE_SQL} AS overdue FROM it")
def i5(t):
    return items(t).select("id", C.overdue(NOW).alias("overdue"))


@query("i5_due_count", f"""WITH {ITEMS_SQL}, u AS (SELECT * FROM ie WHERE starts_at IS NOT NULL AND done_at IS NULL AND removed_at IS NULL
  AND ((kind = 'todo' AND starts_at < TIMESTAMP '{NOW}') OR (fin >= TIMESTAMP '{NOW}' AND starts_at < TIMESTAMP '{NOW}' + INTERVAL 2 DAY)))
SELECT count(*) FILTER (WHERE (kind = 'todo' AND starts_at < TIMESTAMP '{NOW}') OR CAST(starts_at + INTERVAL 1 HOUR AS DATE) = DATE '1998-06-15') AS due FROM u""")
def i5d(t):
    return C.due_count(items(t), NOW, "Africa/Tunis")


DAYS_SQL = """dy AS (SELECT *, CAST(starts_at + INTERVAL 1 HOUR AS DATE) AS a, CAST(CASE WHEN ends_at > starts_at THEN ends_at + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND ELSE starts_at + INTERVAL 1 HOUR END AS DATE) AS z FROM {0} WHERE starts_at IS NOT NULL),
ex AS (SELECT *, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM dy)"""


@query("i6_expand_days", f"""WITH {ITEMS_SQL}, {DAYS_SQL.format('it')}
SELECT id, count(*) AS days, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM ex GROUP BY 1""")
def i6(t):
    d = C.expand_days(items(t), "Africa/Tunis")
    return d.groupBy("id").agg(F.count("*").alias("days"), F.min("day").cast("string").alias("first_day"),
                               F.max("day").cast("string").alias("last_day"))


@query("i7_agenda", f"""WITH {ITEMS_SQL}, {DAYS_SQL.format(f"(SELECT * FROM it WHERE kind <> 'note' AND NOT {LATE_SQL})")},
 a AS (SELECT NULL AS section, id FROM it WHERE {LATE_SQL} UNION ALL SELECT CAST(day AS VARCHAR), id FROM ex WHERE day >= DATE '1998-06-15')
SELECT section, count(*) AS items, min(id) AS low_id, max(id) AS high_id, CAST(sum(id) AS BIGINT) AS id_sum FROM a GROUP BY 1""")
def i7(t):
    a = C.agenda(items(t), NOW, "Africa/Tunis")
    return a.groupBy(F.col("section").cast("string").alias("section")).agg(
        F.count("*").alias("items"), F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.sum("id").alias("id_sum"))


@query("i8_month_grid", f"""WITH {ITEMS_SQL}, {DAYS_SQL.format("(SELECT * FROM it WHERE kind <> 'note')")},
 c AS (SELECT generate_series AS cell, CAST(DATE '1998-06-01' + CAST(generate_series AS INTEGER) AS DATE) AS day FROM generate_series(0, 41))
SELECT cell, CAST(c.day AS VARCHAR) AS day, id, a < c.day AS continued FROM c LEFT JOIN ex ON ex.day = c.day""")
def i8(t):
    g = C.month_grid(items(t), "1998-06-20", "Africa/Tunis")
    return g.select("cell", F.col("day").cast("string").alias("day"), "id", "continued")


@query("i9_windowed_fetch", f"""WITH {ITEMS_SQL}, w AS (SELECT TIMESTAMP '{NOW}' - INTERVAL 30 DAY + to_days(CAST(84 * g AS INTEGER)) AS w_start, least(TIMESTAMP '{NOW}' - INTERVAL 30 DAY + to_days(CAST(84 * (g + 1) AS INTEGER)), TIMESTAMP '{NOW}' + INTERVAL 180 DAY) AS w_end FROM range(3) r(g))
SELECT strftime(w_start, '%Y-%m-%d %H:%M') AS w_start, strftime(w_end, '%Y-%m-%d %H:%M') AS w_end, count(*) AS due FROM w JOIN (SELECT starts_at, coalesce(ends_at, CASE WHEN all_day THEN starts_at + INTERVAL 1 DAY ELSE starts_at END) AS e FROM it) x ON e >= w_start AND starts_at < w_end WHERE e >= starts_at GROUP BY 1, 2""")
def i9(t):
    """How many items each fetch window brings."""
    w = C.tile_windows(t.spark, NOW)
    j = C.overlap_join(items(t), w)
    fmt = "yyyy-MM-dd HH:mm"
    return j.groupBy(F.date_format("w_start", fmt).alias("w_start"), F.date_format("w_end", fmt).alias("w_end")).agg(
        F.count("*").alias("due"))


def feed(t):
    """Orders as calendar items of their customer's market segment; finished ones have no end of their own."""
    seg = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("calendar_id"))
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return t.orders.join(seg, "o_custkey").select(
        F.col("o_orderkey").cast("string").alias("source_id"), "calendar_id",
        F.when(F.col("o_totalprice") < 20000, "  ").otherwise(F.concat(F.lit(" order "), "o_orderkey")).alias("title"),
        F.when(F.col("o_orderpriority") != "5-LOW", day).alias("start"),
        F.when(F.col("o_orderstatus") == "O", day + F.expr("INTERVAL 3 DAY")).alias("end"),
        F.col("o_orderpriority").alias("description"))


def feed_folders(t):
    segments = t.customer.select(F.col("c_mktsegment").alias("calendar_id")).distinct()
    return segments.filter("calendar_id <> 'BUILDING'").withColumn("folder", F.lower("calendar_id"))


FEED_SQL = """fd AS (SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'order ' || o_orderkey AS title, lower(c_mktsegment) AS course, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 3 DAY END,
   CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END) AS starts_at, o_orderpriority AS body, o_totalprice AS price, o_orderstatus AS st FROM orders JOIN customer ON c_custkey = o_custkey
   WHERE c_mktsegment <> 'BUILDING' AND o_totalprice >= 20000 AND (o_orderstatus = 'O' OR o_orderpriority <> '5-LOW')),
 cu AS (SELECT source_id, CASE WHEN price > 200000 THEN title ELSE 'old ' || title END AS title, course, starts_at, 'mine' AS body, CASE WHEN price > 400000 THEN starts_at END AS removed_at FROM fd WHERE st <> 'F'),
 inc AS (SELECT * FROM fd WHERE st <> 'P')"""


@query("i10_to_deadlines", f"WITH {FEED_SQL} SELECT source_id, title, course, strftime(starts_at, '%Y-%m-%d') AS due, body FROM fd")
def i10(t):
    d = C.to_deadlines(feed(t), feed_folders(t))
    return d.select("source_id", "title", "course", F.date_format("starts_at", "yyyy-MM-dd").alias("due"), "body")


def imports(t):
    """What the planner has (unfinished orders, cheap ones under an old title) and what the feed now returns."""
    rows = C.to_deadlines(feed(t), feed_folders(t))
    o = t.orders.select(F.col("o_orderkey").cast("string").alias("source_id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("st"))
    j = rows.join(o, "source_id")
    current = j.filter("st <> 'F'").select(
        "source_id", F.when(F.col("price") > 200000, F.col("title")).otherwise(F.concat(F.lit("old "), "title")).alias("title"), "course", "starts_at",
        F.lit("mine").alias("body"), F.lit(None).cast("timestamp_ntz").alias("done_at"),
        F.when(F.col("price") > 400000, F.col("starts_at")).alias("removed_at"))
    return current, j.filter("st <> 'P'").select(*rows.columns)


@query("i11_upsert_deadlines", f"""WITH {FEED_SQL}
SELECT coalesce(c.source_id, i.source_id) AS source_id, coalesce(i.title, c.title) AS title, coalesce(c.body, i.body) AS body, i.source_id IS NULL AND removed_at IS NOT NULL AS removed,
  CASE WHEN c.source_id IS NULL THEN 'new' WHEN i.source_id IS NOT NULL AND (c.title <> i.title OR removed_at IS NOT NULL) THEN 'updated' ELSE 'unchanged' END AS change
FROM cu c FULL JOIN inc i ON c.source_id = i.source_id""")
def i11(t):
    out = C.upsert_deadlines(*imports(t))
    return out.select("source_id", "title", "body", F.col("removed_at").isNotNull().alias("removed"), "change")


@query("i11_dry_run_counts", f"""WITH {FEED_SQL}, x AS (SELECT c.source_id AS c, i.source_id AS i, c.title <> i.title OR removed_at IS NOT NULL AS d FROM cu c FULL JOIN inc i ON c.source_id = i.source_id)
SELECT (SELECT count(*) FROM x WHERE c IS NULL) AS new, (SELECT count(*) FROM x WHERE c IS NOT NULL AND i IS NOT NULL AND d) AS updated,
 (SELECT count(*) FROM cu WHERE removed_at IS NULL AND course = 'machinery' AND starts_at >= TIMESTAMP '1998-01-01' AND starts_at < TIMESTAMP '2001-01-01' AND source_id NOT IN (SELECT source_id FROM inc)) AS removed""")
def i11c(t):
    current, incoming = imports(t)
    scope = feed_folders(t).filter("folder = 'machinery'").select(F.col("folder").alias("course"))
    after = C.mark_removed(current, incoming, scope, "1998-01-01", "2001-01-01", NOW)
    return C.import_counts(C.upsert_deadlines(current, incoming), current, after)


@query("i12_mark_removed", f"""WITH {FEED_SQL}
SELECT source_id, removed_at IS NOT NULL OR (course IN ('machinery', 'furniture') AND starts_at >= TIMESTAMP '1998-01-01' AND starts_at < TIMESTAMP '2001-01-01' AND source_id NOT IN (SELECT source_id FROM inc)) AS removed FROM cu""")
def i12(t):
    current, incoming = imports(t)
    scope = feed_folders(t).filter("folder IN ('machinery', 'furniture')").select(F.col("folder").alias("course"))
    out = C.mark_removed(current, incoming, scope, "1998-01-01", "2001-01-01", NOW)
    return out.select("source_id", F.col("removed_at").isNotNull().alias("removed"))


@query("i14_apply_edits", f"""WITH {ITEMS_SQL}, e AS (SELECT *, CASE WHEN all_day THEN title ELSE 'x ' || title END AS nt, CASE WHEN kind = 'note' THEN 'moved' ELSE course END AS nc FROM it WHERE id IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))),
 j AS (SELECT it.*, e.id IS NOT NULL AS has, nt, nc, CASE WHEN it.kind = 'todo' THEN TRUE END AS dn FROM it LEFT JOIN e ON e.id = it.id),
 k AS (SELECT *, has AND (nt <> title OR nc IS DISTINCT FROM course) AS diff, has AND coalesce((done_at IS NOT NULL) <> dn, FALSE) AS tog FROM j),
 v AS (SELECT *, CASE WHEN NOT has THEN 'none' WHEN source = 'feed' AND diff THEN 'title, date and module follow the feed' WHEN filed_path IS NOT NULL AND nc IS DISTINCT FROM course THEN 'a filed note stays in its drawer: move the file instead'
      WHEN diff OR tog THEN 'changed' ELSE 'unchanged' END AS outcome FROM k)
SELECT id, CASE WHEN outcome = 'changed' THEN nt ELSE title END AS title, CASE WHEN outcome = 'changed' THEN nc ELSE course END AS course,
  CASE WHEN outcome = 'changed' AND tog THEN dn ELSE done_at IS NOT NULL END AS done, outcome FROM v""")
def i14(t):
    """Customers of one segment retitle their timed items, move their notes and tick their to-dos."""
    i = items(t)
    mine = t.orders.join(t.customer.filter("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"))
    title = F.when(F.col("all_day"), F.col("title")).otherwise(F.concat(F.lit("x "), "title"))
    edits = i.join(mine, "id", "left_semi").select(
        "id", F.array(F.lit("title"), F.lit("course")).alias("fields"), title.alias("title"),
        F.when(F.col("kind") == "note", "moved").otherwise(F.col("course")).alias("course"), F.when(F.col("kind") == "todo", True).alias("done"))
    out = C.apply_edits(i, edits, NOW)
    return out.select("id", "title", "course", F.col("done_at").isNotNull().alias("done"), "outcome")


@query("i14_set_filed", f"WITH {ITEMS_SQL} SELECT id, CASE WHEN source = 'feed' THEN 'filed/' || id || '.md' ELSE filed_path END AS filed_path FROM it WHERE kind = 'note'")
def i14f(t):
    notes = items(t).filter("kind = 'note'")
    filed = notes.filter("source = 'feed'").select("id", F.concat(F.lit("filed/"), "id", F.lit(".md")).alias("filed_path"))
    return C.set_filed(notes, filed).select("id", "filed_path")


TAGGED = [("der", "German"), ("the", "English"), ("of the", "English"), ("los", "Spanish"), ("de la", "Spanish"),
          ("que", "French"), ("est", "French")]
MODULES = ["German", "English", "Spanish", "French"]
_BOUND = r"(^|[^\p{{L}}\p{{N}}_/:]){0}($|[^\p{{L}}\p{{N}}_/])"
TAGS_SQL = " UNION ALL ".join(
    f"SELECT line_id, '{m}' AS module, '{a}' AS alias, length(split_part(regexp_replace(t, '{_BOUND.format(a)}', '\\1' || chr(1)), chr(1), 1)) AS start "
    f"FROM l WHERE regexp_matches(t, '{_BOUND.format(a)}')" for a, m in TAGGED + [(m.lower(), m) for m in MODULES])


@query("i15_tag_modules", f"""
WITH l AS (SELECT doc_id * 1000000 + generate_subscripts(string_split(text, chr(10)), 1) AS line_id, lower(strip_accents(unnest(string_split(text, chr(10))))) AS t FROM documents),
 h AS ({TAGS_SQL})
SELECT line_id, module, start, start + length(alias) AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY length(alias) DESC, start, module) AS r FROM h) WHERE r = 1""")
def i15(t):
    """Lines of the documents against a list of function words; the alias of a missing module is ignored."""
    lines = t.texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        (F.col("doc_id") * 1_000_000 + F.col("pos") + 1).alias("line_id"), "text")
    modules = t.spark.createDataFrame([(m,) for m in MODULES], "module string")
    aliases = t.spark.createDataFrame([*TAGGED, ("and", "Gone")], "alias string, module string")
    return P.tag_modules(lines, aliases, modules)


@query("i16_parse_lines")
def i16(t):
    lines = t.texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return P.parse_lines(lines, datetime(2026, 9, 29, 13, 0)).select(
        "doc_id", "pos", "kind", F.md5("title").alias("title_md5"), F.col("starts_at").cast("string").alias("starts_at"), "all_day")


@query("i16_parse_dates", f"""WITH {ITEMS_SQL}
SELECT id, CASE WHEN kind = 'event' THEN 'event' ELSE 'todo' END AS kind, CASE WHEN kind = 'event' THEN 'exam ' || id ELSE 'tp ' || id END AS title,
  strftime(CASE WHEN kind = 'event' THEN created_at + INTERVAL 9 HOUR ELSE created_at + INTERVAL 23 HOUR + INTERVAL 59 MINUTE END, '%Y-%m-%d %H:%M') AS starts_at FROM it""")
def i16d(t):
    """Every order date written out as a line and read back: day/month/year with a time, or a spelled month."""
    i = items(t)
    day = F.col("created_at")
    line = F.when(F.col("kind") == "event", F.concat(F.lit("exam "), "id", F.lit(" "), F.date_format(day, "d/M/yyyy"), F.lit(" 9h"))).otherwise(
        F.concat(F.lit("tp "), "id", F.lit(" le "), F.date_format(day, "d MMM yyyy")))
    out = P.parse_lines(i.select("id", line.alias("text")), datetime(1995, 1, 1, 0, 0))
    return out.select("id", "kind", "title", F.date_format("starts_at", "yyyy-MM-dd HH:mm").alias("starts_at"))


@query("i18_planner_lists", f"WITH {ITEMS_SQL} SELECT id, kind, done_at IS NOT NULL AS done FROM it WHERE kind IN ('todo', 'note') AND (contains(lower(title), 'f 3') OR contains(lower(body), 'f 3'))")
def i18(t):
    return C.planner_lists(items(t), " F 3").select("id", "kind", "done")
