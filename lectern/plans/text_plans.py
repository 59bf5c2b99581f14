"""Registered queries: text preparation and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from .registry import query

STOP_SQL = ",".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(X.STOP_WORDS))
FR_SQL = ",".join(f"'{w}'" for w in X.FRENCH_WORDS)
EN_SQL = ",".join(f"'{w}'" for w in X.ENGLISH_WORDS)

# The reading rules written once as SQL scalar expressions over a column called text.
TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
TIDY = TRIM.format(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\x{{00AD}}', '', 'g'), "
    r"'([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '[ \t\x{{00A0}}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), "
    r"'\n{{3,}}', chr(10) || chr(10), 'g')")
READS = (r"length(regexp_replace({0}, '\s', '', 'g')) > 0 "
         r"AND len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]{{3,}}')) >= 2 "
         r"AND length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 0.6 * length(regexp_replace({0}, '\s', '', 'g'))")


def by_words(col):
    return X.n_tokens(col, "words")


@query("b1_normalize", f"""
SELECT doc_id, md5({TIDY.format('text')}) AS text_md5, length({TIDY.format('text')}) AS chars FROM documents
""")
def b1(t):
    d = t.texts.select("doc_id", X.normalize(F.col("text")).alias("n"))
    return d.select("doc_id", F.md5("n").alias("text_md5"), F.length("n").alias("chars"))


@query("b2_clean_title", r"""
WITH p AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS raw,
                  regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS path FROM pages),
     s AS (SELECT *, trim(regexp_replace(regexp_replace(trim(raw), '^Microsoft (PowerPoint|Word) - ', ''),
                                         '(?i)\.(pptx?|docx?)$', '')) AS t FROM p)
SELECT page_id, CASE WHEN t = '' OR regexp_matches(t, '(?i)^(powerpoint presentation|présentation powerpoint|presentation|présentation|diapositive \d+|slide \d+|document|untitled|sans titre|microsoft word - .*|(template|modèle|modele)\b.*)$')
       THEN regexp_replace(split_part(path, '/', -1), '(.)\.[^.]+$', '\1') ELSE t END AS title FROM s
""")
def b2(t):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "")
    raw = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return t.pages.select("page_id", X.clean_title(raw, path).alias("title"))


@query("b3_text_status", r"""
SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS chars, 1 AS pages,
       CASE WHEN length(regexp_replace(text, '\s', '', 'g')) >= CASE WHEN lang = 'en' THEN 30 ELSE 1 END
            THEN 'ok' ELSE 'empty_text' END AS status
FROM documents
""")
def b3(t):
    mime = F.when(F.col("lang") == "en", X.MIME_BY_EXTENSION["pdf"]).otherwise("text/plain")
    return C.text_status(t.texts.select("doc_id", "text", mime.alias("mime")))


@query("b4_clean_lines", f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format('x')}),
                                      lambda x: {READS.format('x')}) AS kept FROM documents)
SELECT doc_id, len(kept) AS kept_lines, md5(array_to_string(kept, chr(10))) AS text_md5 FROM l
""")
def b4(t):
    kept = X.clean_lines(F.col("text"))
    n = F.when(F.col("k") == "", 0).otherwise(F.size(F.split("k", "\n")))
    return (t.texts.select("doc_id", kept.alias("k"))
            .select("doc_id", n.alias("kept_lines"), F.md5("k").alias("text_md5")))


@query("b5_new_lines", f"""
WITH p AS (SELECT d.doc_id, d.text AS extra, b.text AS base FROM documents d JOIN documents b ON b.doc_id = d.doc_id - 1),
     l AS (SELECT doc_id, list_transform(string_split(base, chr(10)), lambda x: {TRIM.format('x')}) AS known,
                  list_transform(string_split(extra, chr(10)), lambda x: {TRIM.format('x')}) AS lines FROM p)
SELECT doc_id, md5(array_to_string(list_filter(lines, lambda x: x <> '' AND NOT list_contains(known, x) AND {READS.format('x')}),
                                   chr(10))) AS text_md5 FROM l
""")
def b5(t):
    base = t.documents.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("base"))
    d = t.documents.select("doc_id", F.col("text").alias("extra")).join(base, "doc_id")
    return d.select("doc_id", F.md5(X.new_lines(F.col("base"), F.col("extra"))).alias("text_md5"))


@query("b6_drop_repeated", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
     c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sha1(block)) AS n FROM l)
SELECT doc_id, pos, md5(block) AS block_md5 FROM c WHERE n = 1
""")
def b6(t):
    lines = t.texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "block"))
    return C.drop_repeated(lines).select("doc_id", "pos", F.md5("block").alias("block_md5"))


@query("b7_sections", f"""
WITH n AS (SELECT conv_id, turn, role, text,
                  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section
           FROM conversations),
     g AS (SELECT conv_id, section, max(CASE WHEN role = 'user' THEN text END) AS label,
                  string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM n GROUP BY 1, 2)
SELECT conv_id, CAST(section AS BIGINT) AS section, label, md5({TIDY.format('body')}) AS text_md5 FROM g
WHERE {TIDY.format('body')} <> ''
""")
def b7(t):
    lines = t.conversations.select("conv_id", F.col("turn").alias("ord"), "text",
                                   (F.col("role") == "user").alias("is_heading"))
    s = C.sections(lines, ["conv_id"])
    return s.select("conv_id", F.col("section").cast("bigint").alias("section"), "label",
                    F.md5("text").alias("text_md5"))


#: Units of all texts in order: paragraphs of at most 500 tokens, else their sentences, else runs of words. ``win`` walks
#: the words of over-long sentences one by one.
UNITS_SQL = rf"""
p AS (SELECT doc_id, i, {TRIM.format("x")} AS para FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS x,
    generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents)),
q AS (SELECT *, greatest(1, length(para) // 3) AS n FROM p WHERE para <> ''),
l AS (SELECT doc_id, i, string_split(regexp_replace(para, '([.!?؟۔؛])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM q WHERE n > 500),
s AS (SELECT *, greatest(1, length(unit) // 3) AS n FROM (SELECT doc_id, i, 0 AS j, para AS unit FROM q WHERE n <= 500
    UNION ALL SELECT doc_id, i, j, {TRIM.format("x")} FROM (SELECT doc_id, i, unnest(parts) AS x, generate_subscripts(parts, 1) AS j FROM l)) WHERE unit <> ''),
long AS (SELECT doc_id, i, j, list_filter(regexp_split_to_array(unit, '\s+'), lambda w: w <> '') AS ws FROM s WHERE n > 500),
win(doc_id, i, j, k, used, no) AS (SELECT doc_id, i, j, 1, greatest(1, length(ws[1]) // 3), 0 FROM long
  UNION ALL SELECT doc_id, i, j, k + 1, CASE WHEN used + c > 500 THEN c ELSE used + c END, CASE WHEN used + c > 500 THEN no + 1 ELSE no END
  FROM (SELECT win.*, greatest(1, length(ws[k + 1]) // 3) AS c FROM win JOIN long USING (doc_id, i, j) WHERE k < len(ws))),
runs AS (SELECT doc_id, i, j, no, string_agg(ws[k], ' ' ORDER BY k) AS unit FROM win JOIN long USING (doc_id, i, j) GROUP BY ALL),
u AS (SELECT *, greatest(1, length(unit) // 3) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, no) AS ord
  FROM (SELECT doc_id, i, j, 0 AS no, unit FROM s WHERE n <= 500 UNION ALL SELECT doc_id, i, j, no, unit FROM runs))"""
#: Chunks of at most 500 tokens with up to 80 tokens of overlap: a walk over each document's units, which remembers where
#: the current chunk began.
CHUNKS_SQL = rf"""{UNITS_SQL},
d AS (SELECT doc_id, list(n ORDER BY ord) AS ns, list(unit ORDER BY ord) AS us, list(upto ORDER BY ord) AS pre
  FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY ord) - n AS upto FROM u) GROUP BY doc_id),
walk(doc_id, i, first, used, no) AS (SELECT doc_id, 1, 1, ns[1], 0 FROM d
  UNION ALL SELECT doc_id, i + 1, CASE WHEN used + n > 500 THEN f ELSE first END,
    CASE WHEN used + n > 500 THEN pre[i + 1] - pre[f] + n ELSE used + n END, CASE WHEN used + n > 500 THEN no + 1 ELSE no END
  FROM (SELECT walk.*, ns[i + 1] AS n, pre, CASE WHEN used + ns[i + 1] > 500 THEN coalesce(list_min(list_filter(range(first, i + 2),
      lambda k: pre[i + 1] - pre[k] <= least(80, 500 - ns[i + 1]))), i + 1) END AS f FROM walk JOIN d USING (doc_id) WHERE i < len(ns))),
chunk AS (SELECT doc_id, no AS ord, array_to_string(us[min(first):max(i)], chr(10)) AS text FROM walk JOIN d USING (doc_id) GROUP BY doc_id, no, us)"""


@query("b8_units", f"""
WITH p AS (SELECT doc_id, {TRIM.format("unnest(string_split(text, chr(10) || chr(10)))")} AS para FROM documents),
     q AS (SELECT doc_id, para, greatest(1, length(para) // 3) AS n FROM p WHERE para <> ''),
     s AS (SELECT doc_id, para AS unit FROM q WHERE n <= 500
           UNION ALL
           SELECT doc_id, {TRIM.format("unnest(string_split(regexp_replace(para, '([.!?؟۔؛])\\s+', '\\1' || chr(1), 'g'), chr(1)))")}
           FROM q WHERE n > 500)
SELECT doc_id, md5(unit) AS unit_md5, CAST(count(*) AS BIGINT) AS times, CAST(max(greatest(1, length(unit) // 3)) AS BIGINT) AS n_tokens
FROM s WHERE unit <> '' AND greatest(1, length(unit) // 3) <= 500 GROUP BY 1, 2
""")
def b8(t):
    """Paragraph and sentence units; the windows of over-long sentences are in b8_all_units."""
    u = C.units(t.texts.select("doc_id", "text"), 500, keys=("doc_id",), windows=False)
    return u.groupBy("doc_id", F.md5("text").alias("unit_md5")).agg(
        F.count("*").alias("times"), F.max("n_tokens").cast("bigint").alias("n_tokens"))


@query("b8_all_units", f"""WITH RECURSIVE {UNITS_SQL}
SELECT doc_id, md5(unit) AS unit_md5, CAST(count(*) AS BIGINT) AS times, CAST(max(n) AS BIGINT) AS n_tokens FROM u GROUP BY 1, 2""")
def b8_all(t):
    """All units, the windows of over-long sentences included."""
    u = C.units(t.texts.select("doc_id", "text"), 500, keys=("doc_id",))
    return u.groupBy("doc_id", F.md5("text").alias("unit_md5")).agg(
        F.count("*").alias("times"), F.max("n_tokens").cast("bigint").alias("n_tokens"))


@query("b8_word_windows", """
SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' ')) AS words_md5,
       TRUE AS within_budget FROM documents
""")
def b8w(t):
    """No unit is over budget, and the units of a document in order give back all of its words, be they none."""
    u = C.units(t.texts.select("doc_id", F.col("text").isNull().alias("missing"), "text"), 40, keys=("doc_id", "missing"),
                count=by_words, outer=True)
    return words_again(u, 40)


def words_again(pieces, budget):
    """A row per document: its words from its pieces in order (NULL for a missing text), and whether each piece fits."""
    parts = F.sort_array(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "text"))))
    g = pieces.groupBy("doc_id", "missing").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("all"),
                                                F.max("n_tokens").alias("m"))
    return g.select("doc_id", F.when(~F.col("missing"), F.md5(F.array_join(X.bounded_words(F.col("all")), " "))).alias("words_md5"),
                    F.coalesce(F.col("m") <= budget, F.lit(True)).alias("within_budget"))


@query("b9_chunk_pages", f"""WITH RECURSIVE {CHUNKS_SQL}
SELECT doc_id, 1 AS page, ord, md5(text) AS text_md5, CAST(greatest(1, length(text) // 3) AS INTEGER) AS n_tokens FROM chunk""")
def b9(t):
    return (C.chunk_pages(t.texts.select("doc_id", F.lit(1).alias("page"), "text"))
            .select("doc_id", "page", "ord", F.md5("text").alias("text_md5"), "n_tokens"))


@query("b9_chunk_invariants", """
SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' ')) AS words_md5,
       TRUE AS within_budget FROM documents
""")
def b9i(t):
    """Chunks without overlap keep every word in order, be they none, and stay within the budget."""
    c = C.chunk_pages(t.texts.select("doc_id", F.col("text").isNull().alias("missing"), "text"), overlap=0,
                      keys=("doc_id", "missing"), count=by_words, outer=True)
    return words_again(c, 500)


@query("b10_token_count", r"""
SELECT doc_id, CAST(greatest(1, length(text) // 3) AS BIGINT) AS by_chars,
       CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS by_words FROM documents
""")
def b10(t):
    return t.texts.select("doc_id", X.n_tokens(F.col("text")).cast("bigint").alias("by_chars"),
                              X.n_tokens(F.col("text"), "words").cast("bigint").alias("by_words"))


@query("b11_chunk_meta", """
SELECT doc_id, 1 AS page, source || '/' || doc_id || '.txt' AS source, source AS course, lang AS label, lang = 'en' AS ocr
FROM documents WHERE regexp_matches(text, '\\S')
""")
def b11(t):
    """Metadata of the document and of the page end up on every chunk of it (each kind of row once)."""
    d = t.texts
    docs = d.select("doc_id", F.concat_ws("/", "source", F.concat("doc_id", F.lit(".txt"))).alias("path"),
                    F.col("source").alias("course"), F.lit(None).cast("timestamp_ntz").alias("mtime"))
    pages = d.select("doc_id", F.lit(1).alias("page"), F.col("lang").alias("label"),
                     F.when(F.col("lang") == "en", True).alias("ocr"), "text")
    chunks = C.chunk_pages(pages)
    return C.chunk_meta(chunks, pages, docs).select("doc_id", "page", "source", "course", "label", "ocr").distinct()


@query("b12_detect_lang", rf"""
WITH w AS (SELECT doc_id, lang, lower(text) AS low, text,
                  regexp_extract_all(translate(lower(text), '’''', '  '), '[a-zà-ÿ]+') AS words FROM documents),
     c AS (SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{Nl}}\p{{No}}]')) AS letters,
                  len(regexp_extract_all(text, '\p{{Arabic}}')) AS arabic,
                  len(list_filter(words, lambda x: x IN ({FR_SQL}))) + CASE WHEN regexp_matches(low, '{X.FRENCH_ACCENTS}') THEN 2 ELSE 0 END AS fr,
                  len(list_filter(words, lambda x: x IN ({EN_SQL}))) AS en FROM w)
SELECT doc_id, lang, CASE WHEN letters > 0 AND arabic / letters > 0.3 THEN 'ar' WHEN fr > en THEN 'fr' ELSE 'en' END AS guess FROM c
""")
def b12(t):
    return t.texts.select("doc_id", "lang", X.detect_lang(F.col("text")).alias("guess"))


@query("b13_keywords", rf"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM conversations WHERE role = 'user'),
     e AS (SELECT conv_id, turn, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
     k AS (SELECT conv_id, turn, w, min(i) AS i FROM e WHERE length(w) > 1 AND w NOT IN ({STOP_SQL}) GROUP BY 1, 2, 3)
SELECT c.conv_id, c.turn, coalesce(string_agg(k.w, ' ' ORDER BY k.i), '') AS keywords
FROM conversations c LEFT JOIN k USING (conv_id, turn) WHERE c.role = 'user' GROUP BY 1, 2
""")
def b13(t):
    users = t.conversations.filter("role = 'user'")
    return users.select("conv_id", "turn", F.array_join(X.keywords(X.nfkc("text")), " ").alias("keywords"))


@query("b14_snippet", r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 240 THEN s ELSE regexp_replace(left(s, 240), ' [^ ]*$', '') || '…' END AS snippet FROM f
""")
def b14(t):
    return t.texts.select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("b15_excerpt", r"""
WITH l AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)),
             lambda x: NOT regexp_matches(x, '^\s*#{1,6}\s') AND NOT regexp_matches(x, '^\s*\*[^*].*›.*\*\s*$')), ' ') AS b FROM documents),
     s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b,
             '!\[[^\]]*\]\((<[^>]*>|[^)]*)\)', '', 'g'), '\*\*|__|`', '', 'g'), '(^|\s)[*_](\S)', '\1\2', 'g'),
             '(\S)[*_](\s|$)', '\1\2', 'g'), '\s+', ' ', 'g')) AS s FROM l)
SELECT doc_id, CASE WHEN length(s) <= 240 THEN s ELSE regexp_replace(left(s, 240), '\s+\S*$', '') || '…' END AS excerpt,
       md5(s) AS body_md5 FROM s
""")
def b15(t):
    return t.texts.select("doc_id", X.excerpt(F.col("text")).alias("excerpt"),
                              F.md5(X.excerpt(F.col("text"), 10_000_000)).alias("body_md5"))


@query("b15_without_leading_title", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace('# ' || source || chr(10) || chr(10) || '*' || lang || ' › ' || source || '*' || chr(10) || text,
       '\A\s*#\s[^\n]*\n+', ''), '\A\s*\*[^*\n]*›[^*\n]*\*\s*\n+', '')) AS body_md5 FROM documents
""")
def b15w(t):
    note = F.concat(F.lit("# "), "source", F.lit("\n\n*"), "lang", F.lit(" › "), "source", F.lit("*\n"), "text")
    return t.texts.select("doc_id", F.md5(X.without_leading_title(note)).alias("body_md5"))


@query("b16_normalise_math", r"""
WITH m AS (SELECT conv_id, turn, replace(replace(text, ', ', ' \( a_1 \) '), '. ', ' \[x^2\] ') AS s FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(s, '(?s)\\\[(.+?)\\\]', '$$\1$$', 'g'),
                                         '(?s)\\\(\s*(.+?)\s*\\\)', '$\1$', 'g')) AS text_md5 FROM m
""")
def b16(t):
    marked = F.replace(F.replace("text", F.lit(", "), F.lit(r" \( a_1 \) ")), F.lit(". "), F.lit(r" \[x^2\] "))
    return t.conversations.select("conv_id", "turn", F.md5(X.normalise_math(marked)).alias("text_md5"))


@query("b17_strip_reasoning", r"""
SELECT conv_id, turn, md5(regexp_replace(CASE WHEN contains(s, '</think>') THEN list_last(string_split(s, '</think>')) ELSE s END,
       CASE WHEN contains(s, '</think>') THEN '^\s+' ELSE '^$' END, '')) AS text_md5
FROM (SELECT conv_id, turn, replace(text, '. ', '. </think> ') AS s FROM conversations)
""")
def b17(t):
    s = F.replace("text", F.lit(". "), F.lit(". </think> "))
    return t.conversations.select("conv_id", "turn", F.md5(X.strip_reasoning(s)).alias("text_md5"))


@query("b18_first_sentence", rf"""
SELECT doc_id, left(split_part(regexp_replace({TRIM.format('text')}, '([.!?])\s', '\1' || chr(1)), chr(1), 1), 200) AS first_sentence
FROM documents
""")
def b18(t):
    return t.documents.select("doc_id", X.first_sentence(F.col("text")).alias("first_sentence"))


@query("b19_call_number", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages),
     s AS (SELECT page_id, path, string_split(path, '/') AS parts, split_part(path, '/', 1) AS course FROM p),
     w AS (SELECT *, list_filter(regexp_split_to_array(course, '[\s_-]+'), lambda x: x <> '') AS ws,
                  CASE WHEN len(parts) > 2 THEN parts[2:len(parts)-1] ELSE [] END AS inner_parts FROM s)
SELECT page_id, upper(CASE WHEN len(ws) = 1 THEN left(course, 6) ELSE array_to_string(list_transform(ws, lambda x: left(x, 1)), '') END)
       || ' · p. ' || page_id AS call_number,
       array_to_string(inner_parts, ' › ') AS folder FROM w
""")
def b19(t):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", ""), "/+$", "")
    p = t.pages.select("page_id", path.alias("path")).withColumn("course", F.element_at(F.split("path", "/"), 1))
    pdf = F.lit(X.MIME_BY_EXTENSION["pdf"])
    return p.select("page_id", X.call_number(F.col("course"), F.col("path"), pdf, F.col("page_id"),
                                             F.lit(None).cast("string")).alias("call_number"),
                    X.folder_trail(F.col("path")).alias("folder"))


@query("b19_chapter_code", r"""
WITH s AS (SELECT p_partkey, 'shelf/' || p_type || '/' || CASE WHEN p_size < 10 THEN 'Chapter ' || p_size WHEN p_size < 20 THEN 'S' || p_size || ' intro'
              WHEN p_size < 30 THEN 'Workshop ' || p_size WHEN p_size < 40 THEN 'chapitre : ' || p_size ELSE p_name END || '/x.pdf' AS path FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(path, '(?i)/chap(ter|itre)') THEN 'CH' || regexp_extract(path, '(?i)/chap(?:ter|itre)?\s*[-:]?\s*(\d+)', 1)
  WHEN regexp_matches(path, '/S\d+ intro') THEN 'S' || regexp_extract(path, '/S(\d+)', 1)
  WHEN regexp_matches(path, '/Workshop') THEN 'WS' || regexp_extract(path, '/Workshop (\d+)', 1) END AS chapter FROM s
""")
def b19c(t):
    z = F.col("p_size")
    seg = (F.when(z < 10, F.concat(F.lit("Chapter "), z)).when(z < 20, F.concat(F.lit("S"), z, F.lit(" intro")))
           .when(z < 30, F.concat(F.lit("Workshop "), z)).when(z < 40, F.concat(F.lit("chapitre : "), z))
           .otherwise(F.col("p_name")))
    path = F.concat(F.lit("shelf/"), "p_type", F.lit("/"), seg, F.lit("/x.pdf"))
    return t.part.select("p_partkey", X.chapter_code(path).alias("chapter"))


@query("b21_literal_search", """
SELECT doc_id, contains(lower(text), 'token =') AS has_token, contains(lower(text), '%%%') AS has_percents,
       contains(lower(text), '_') AS has_underscore FROM documents
""")
def b21(t):
    c = F.col("text")
    return t.documents.select("doc_id", X.icontains(c, "TOKEN =").alias("has_token"),
                              X.icontains(c, "%%%").alias("has_percents"), X.icontains(c, "_").alias("has_underscore"))
