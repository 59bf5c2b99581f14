"""Model answers: citation check, citation rows, claims, log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

NOT_FOUND = "I couldn't find this in your notes."
CITATION = r"\[\d+(?:\s*,\s*\d+)*\]"
# one citation, not escaped and not the text of a link
CITE_LINK = r"(?<![\\$])\[\d+\](?!\()"


def _numbers(mark: Column) -> Column:
    """Numbers of one citation mark; a number too long to be one counts as out of range."""
    parts = F.split(F.regexp_replace(mark, r"[\[\]\s]", ""), ",")
    return F.transform(parts, lambda p: F.coalesce(p.try_cast("bigint"), F.lit(-1).cast("bigint")))


def validate_citations(answers: DataFrame, answer: str = "answer", n_sources: str = "n_sources") -> DataFrame:
    """Check ``[n]`` marks against the sources given: adds ``text``, ``cited``, ``invalid``, ``valid``.

    Out-of-range numbers are removed and listed in ``invalid``; the others are renumbered by first use, and
    ``cited`` maps new number i to original source cited[i - 1]. Valid means something is cited and nothing invalid.
    """
    marks = F.regexp_extract_all(F.col(answer), F.lit(CITATION), 0)
    df = answers.withColumn("_all", F.flatten(F.transform(marks, _numbers)))

    def in_range(n: Column) -> Column:
        return (n >= 1) & (n <= F.col(n_sources))

    df = df.withColumn("cited", F.array_distinct(F.filter("_all", in_range))).withColumn(
        "invalid", F.filter("_all", lambda n: ~in_range(n)))

    def renumbered(mark: Column) -> Column:
        new = F.array_distinct(F.transform(F.filter(_numbers(mark), in_range),
                                           lambda n: F.array_position("cited", n)))
        return F.array_join(F.transform(new, lambda k: F.concat(F.lit("["), k, F.lit("]"))), "")

    text = X.rewrite(F.col(answer), CITATION, renumbered)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+([.,;:!?؟،])", "$1"), r"[ \t]{2,}", " ")
    return (df.withColumn("text", X.strip(text))
            .withColumn("valid", (F.size("cited") > 0) & (F.size("invalid") == 0)).drop("_all"))


def citation_rows(validated: DataFrame, sources: DataFrame, key: str = "question_id") -> DataFrame:
    """One row per kept citation, joined to the source it points to (by original number = rank)."""
    refs = validated.select(key, F.posexplode("cited").alias("_p", "rank"))
    refs = refs.select(key, (F.col("_p") + 1).alias("n"), F.col("rank").cast("int").alias("rank"))
    return refs.join(sources, [key, "rank"]).withColumn("snippet", X.snippet(F.col("text")))


def claims(answers: DataFrame, key: list[str], answer: str = "answer") -> DataFrame:
    """Pieces of each cited block, every piece ending at a run of citations: key, block, ord, text, cites.

    A run keeps its closing punctuation. What follows the last run is a piece without cites; blocks that cite nothing
    are left out.
    """
    blocks = answers.select(*key, F.posexplode(F.split(answer, r"\n+")).alias("block", "_b")).filter(
        F.col("_b").rlike(CITE_LINK))
    ended = F.regexp_replace("_b", rf"((?:{CITE_LINK})(?:\s*{CITE_LINK})*[.,;:!?؟،)]*)", "$1\u0001")
    pieces = F.filter(F.split(ended, "\u0001"), lambda p: p != "")
    rows = blocks.select(*key, "block", F.posexplode(pieces).alias("ord", "text"))
    cites = F.transform(F.regexp_extract_all("text", F.lit(CITE_LINK), 0),
                        lambda m: F.regexp_extract(m, r"\d+", 0))
    return rows.withColumn("cites", F.array_join(F.array_distinct(cites), ","))


def log_rows(questions: DataFrame, retrieved: DataFrame, validated: DataFrame, citations: DataFrame,
             params: dict[str, str]) -> DataFrame:
    """One log row per question: parameters, packed candidates, checked answer, citations, latency.

    ``validated`` has ``question_id, text, valid, latency_ms``; a question without an answer row was refused.
    """
    listed = F.sort_array(F.collect_list(F.struct("n", "chunk_id", "snippet")))
    cites = citations.groupBy("question_id").agg(F.to_json(listed).alias("citations"))
    entry = F.create_map(*[F.lit(x) for kv in params.items() for x in kv])
    j = (questions.join(retrieved, "question_id", "left")
         .join(validated.select("question_id", "text", "valid", "latency_ms"), "question_id", "left")
         .join(cites, "question_id", "left"))
    return j.select("question_id", "question", entry.alias("params"),
                    F.coalesce("retrieved", F.lit("[]")).alias("retrieved"),
                    F.coalesce("text", F.lit(NOT_FOUND)).alias("answer"),
                    F.coalesce("citations", F.lit("[]")).alias("citations"),
                    F.col("valid").alias("citation_valid"), F.col("latency_ms"))


def append_log(rows: DataFrame, path: str, ts: Column) -> None:
    """Append to the log table, partitioned by day."""
    (rows.withColumn("ts", ts).withColumn("day", F.to_date("ts"))
     .write.mode("append").partitionBy("day").parquet(path))
