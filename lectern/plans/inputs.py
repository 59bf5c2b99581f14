"""How the sample tables stand in for the library's own tables, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.answers import NOT_FOUND

NOW = "2024-01-31 00:00:00"
_NF = NOT_FOUND.replace("'", "''")


def query_log(t):
    """events as a question log: errors were refused, sign-ups cite wrongly, purchases never got an answer."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("id"), "ts", F.col("user_id"), F.col("event_type").alias("kind"),
        F.when(k >= 10, F.concat(F.lit("m"), F.floor(k / 10))).alias("course"),
        F.concat(kind, F.lit(" by "), "user_id").alias("question"),
        F.when(kind == "error", NOT_FOUND).when(kind != "purchase", F.concat(F.lit("answer "), k)).alias("answer"),
        F.when(kind == "signup", False).when(kind == "view", True).alias("citation_valid"),
        F.when(kind != "purchase", F.floor(F.col("value") * 1000)).alias("latency_ms"))


LOG_SQL = f"""log AS (SELECT event_id AS id, ts, user_id, event_type AS kind,
  CASE WHEN k >= 10 THEN 'm' || (k // 10) END AS course, event_type || ' by ' || user_id AS question,
  CASE WHEN event_type = 'error' THEN '{_NF}' WHEN event_type <> 'purchase' THEN 'answer ' || k END AS answer,
  CASE WHEN event_type = 'signup' THEN FALSE WHEN event_type = 'view' THEN TRUE END AS citation_valid,
  CASE WHEN event_type <> 'purchase' THEN CAST(floor(value * 1000) AS BIGINT) END AS latency_ms
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""
NF_SQL = f"'{_NF}'"


def marked_answers(t):
    """Assistant turns with citation marks put in: some in range, some not."""
    text = F.col("text")
    for old, new in ((". ", " [2][1]. "), (", ", " [3, 9] , "), (" de ", " [4] de ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return t.conversations.filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), text.alias("answer"),
        F.when(F.col("turn") == 1, 4).otherwise(3).alias("n_sources"), F.length("text").alias("ms"))


MARKED_SQL = """ma AS (SELECT conv_id * 1000 + turn AS question_id, CASE WHEN turn = 1 THEN 4 ELSE 3 END AS n_sources, length(text) AS ms,
  replace(replace(replace(text, '. ', ' [2][1]. '), ', ', ' [3, 9] , '), ' de ', ' [4] de ') AS answer FROM conversations WHERE role = 'assistant'),
mk AS (SELECT question_id, n_sources, unnest(regexp_extract_all(answer, '\\[\\d+(?:\\s*,\\s*\\d+)*\\]')) AS mark,
  generate_subscripts(regexp_extract_all(answer, '\\[\\d+(?:\\s*,\\s*\\d+)*\\]'), 1) AS i FROM ma),
nm AS (SELECT question_id, n_sources, i, unnest(regexp_extract_all(mark, '\\d+'))::BIGINT AS n, generate_subscripts(regexp_extract_all(mark, '\\d+'), 1) AS j FROM mk),
od AS (SELECT question_id, list(n ORDER BY p) AS cited FROM (SELECT question_id, n, min(i * 1000 + j) AS p FROM nm WHERE n BETWEEN 1 AND n_sources GROUP BY 1, 2) GROUP BY 1),
iv AS (SELECT question_id, list(n ORDER BY i, j) AS invalid FROM nm WHERE NOT n BETWEEN 1 AND n_sources GROUP BY 1)"""
