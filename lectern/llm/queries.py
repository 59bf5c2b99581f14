"""The registered queries of this package, with equivalent SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment, chat, exact, fingerprints, html, minhash, mixing, packing, phrases, pii, tokens, toxicity, vectors
from .common import ORACLES, QUERIES, query, read

__all__ = ["ORACLES", "QUERIES"]

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PROBE = "</s>[INST] ok [/INST]"


@query("op4_chat_format", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('system', 'assistant')
  WHEN role = 'assistant' THEN before = 'user' ELSE FALSE END AS ok,
  length(regexp_replace(role, '<(\\\\*\\|im_(start|sep|end)\\|>)', '<\\\\\\1', 'g')) + 12 + 10 + 11
  + length(regexp_replace(text, '<(\\\\*\\|im_(start|sep|end)\\|>)', '<\\\\\\1', 'g')) AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(ok) AND last(role ORDER BY n) = 'assistant' AS valid
FROM e GROUP BY conv_id""")
def op4_chat_format(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.element_at(F.array(F.lit("user"), F.lit("assistant")),
                                               (F.col("id") + 1).cast("int")).alias("role"), F.lit(PROBE).alias("text"))
    return chat.read_back(chat.format_turns(turns.unionByName(probe)))


@query("op6_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256({_AZ}) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY {_AZ})""")
def op6_exact_dedup(spark, sf_dir):
    return exact.exact_groups(read(spark, sf_dir, "documents"))


MIX_SQL = r"""
r AS (SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM s),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS used, coalesce(sum(weight) OVER before, 0) AS gone,
    sum(weight) OVER () AS weights, row_number() OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST) AS n FROM w
  WINDOW before AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min(level, n), 0) AS level FROM (SELECT *, CAST(total - used AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS level FROM c)
  WHERE weight * level <= 3 * source_size AND total > 0),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * (SELECT level FROM l)) AS target FROM w),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
k AS (SELECT source, key, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY source, key),
u AS (SELECT k.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, CASE WHEN need > 0 AND upto - need <= need - (upto - size) THEN 1 ELSE 0 END AS extra FROM u)"""


@query("op10_mix_sources", "WITH " + MIX_SQL.replace("{documents}", "documents") + """
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, x.source_size, x.target, CAST(r.size * (x.whole + x.extra) AS BIGINT) AS taken
FROM r JOIN x ON r.source IS NOT DISTINCT FROM x.source AND r.key = x.key""")
def op10_mix_sources(spark, sf_dir):
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_size") * F.col("_repeats")).alias("taken"))


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    return tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_pack_sequences")
def op9_pack_sequences(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_near_duplicates")
def op2_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@query("op1_personal_data")
def op1_personal_data(spark, sf_dir):
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


@query("op7_html_text")
def op7_html_text(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages"))


@query("op5_near_vectors")
def op5_near_vectors(spark, sf_dir):
    return vectors.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


@query("op12_edit_fingerprints")
def op12_edit_fingerprints(spark, sf_dir):
    return fingerprints.edited_pairs(read(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    return alignment.align_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_phrases", rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_AZ}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i] AS w1, w[i + k - 1] AS wk,
    array_to_string(w[i:i + k - 2], ' ') AS head, array_to_string(w[i + 1:i + k - 1], ' ') AS tail
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS s(k))),
f AS (SELECT lang, k, phrase, any_value(w1) AS w1, any_value(wk) AS wk, any_value(head) AS head, any_value(tail) AS tail, count(*) AS f
  FROM grams GROUP BY lang, k, phrase),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT c.lang, c.k, c.phrase, c.f AS a, a1.f AS l, b1.f AS r, 1 AS part FROM c
    JOIN f a1 ON a1.lang = c.lang AND a1.k = 1 AND a1.phrase = c.w1 JOIN f b1 ON b1.lang = c.lang AND b1.k = c.k - 1 AND b1.phrase = c.tail
  UNION ALL SELECT c.lang, c.k, c.phrase, c.f, a2.f, b2.f, 2 FROM c
    JOIN f a2 ON a2.lang = c.lang AND a2.k = 2 AND a2.phrase = c.head JOIN f b2 ON b2.lang = c.lang AND b2.k = 1 AND b2.phrase = c.wk
    WHERE c.k = 3),
scored AS (SELECT *, (CAST(a AS HUGEINT) * a * 1000000) // (CAST(l AS HUGEINT) * r) AS score FROM cut),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, part) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, head AS phrase, f FROM c WHERE k = 3
  UNION ALL SELECT lang, tail, f FROM c WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT least.* FROM least LEFT JOIN longer ON least.k = 2 AND longer.lang = least.lang AND longer.phrase = least.phrase
  WHERE longer.f IS NULL OR 100 * longer.f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, ranked.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang) t ON t.lang = ranked.lang WHERE rank <= 2000""")
def op11_phrases(spark, sf_dir):
    return phrases.collocations(read(spark, sf_dir, "documents"))
