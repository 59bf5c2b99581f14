"""Rules that only show on larger or odder tables than the samples."""

from datetime import datetime, timedelta
from hashlib import md5

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import fusion, lexical, nearest
from lectern.llm import deobfuscation
from lectern.plans import catalogue, registry, stream_plans
from lectern.session import ensure_checkpoint_dir
from lectern.sources import pages
from lectern.streaming import feeds

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [20, 10_000])
def test_more_events_are_no_more_batches(spark, monkeypatch, rows):
    for name in ("SLICE_ROWS", "FILE_ROWS"):
        monkeypatch.setattr(stream_plans, name, rows, raising=False)
    tables = registry.Tables(spark, SMALL)
    out = feeds.run_available(stream_plans.stamped(stream_plans.Live(tables)).select("event_id", "ts"), "slices")
    assert out.agg(F.count_distinct("_batch")).first()[0] == stream_plans.SLICES
    assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in tables.events.select("event_id").collect())
    bounds = sorted((r.a, r.b) for r in out.groupBy("_batch").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect())
    late = 1801
    assert all((before[1] - after[0]).total_seconds() <= late for before, after in zip(bounds, bounds[1:]))


def stream_of(spark, parts, schema, name):
    folder = feeds.scratch_folder(spark, name)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_bursts_are_told_apart_by_microseconds(spark):
    at = lambda micros: datetime(2026, 1, 1) + timedelta(microseconds=micros)
    parts = [[("a", "late", at(900)), ("a", "early", at(100)), ("b", "one", at(900)), ("b", "two", at(2_000_899)),
              ("c", "one", at(900)), ("c", "two", at(2_000_900))], [("z", "end", datetime(2026, 1, 2))]]
    stream = stream_of(spark, parts, "path string, kind string, ts timestamp", "micros")
    out = feeds.run_available(feeds.settled(stream, "path", "2 seconds", "10 seconds"), "micros")
    assert sorted((r.path, r.last_kind, r.n, r.last_ts) for r in out.collect()) == [
        ("a", "late", 2, at(900)), ("b", "two", 2, at(2_000_899)), ("c", "one", 1, at(900)), ("c", "two", 1, at(2_000_900))]


def test_cut_off_references_stay(spark):
    page = "<html><body><h1>Tea &amp; milk &amp</h1><p>a &lt b &lt; &#233; &#xE9; &eacute;</p></body></html>"
    note = pages.pages_to_notes(spark.createDataFrame([(page, "t")], "html string, title string"), min_prose=1).first()["note"]
    assert note == "# t\n\n# Tea & milk &amp\n\na &lt b < é é é\n"


def query(spark, name, folder, **tables):
    """A registered query on own tables."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return catalogue.QUERIES[name](spark, str(folder)).collect()


def test_windows_that_equal_a_paragraph_are_no_units(spark, tmp_path):
    word = "w" * 299
    text = " ".join([word] * 11) + "\n\n" + " ".join([word] * 5)
    rows = query(spark, "b8_units", tmp_path, documents=([(1, text)], "doc_id bigint, text string"))
    assert [(r.doc_id, r.times, r.n_tokens) for r in rows] == [(1, 1, 499)]


def agree_on_odd_texts(spark, folder, name):
    texts = ["", " \n\t ", None, "\n\n\n\n", "a b.  c\n\nd", " ".join(f"w{i}" for i in range(1200))]
    got = query(spark, name, folder, documents=(list(enumerate(texts)), "doc_id bigint, text string"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, words_md5, within_budget FROM ({catalogue.ORACLES[name]}) ORDER BY doc_id").fetchall()
    assert sorted((r.doc_id, r.words_md5, r.within_budget) for r in got) == want and len(want) == len(texts)


def test_texts_without_words_keep_their_row_among_windows(spark, tmp_path):
    agree_on_odd_texts(spark, tmp_path, "b8_word_windows")


def test_texts_without_words_keep_their_row_among_chunks(spark, tmp_path):
    agree_on_odd_texts(spark, tmp_path, "b9_chunk_invariants")


def test_lists_end_where_their_sql_does(spark):
    small = {n: catalogue.QUERIES[n](spark, "/root/testdata/sf0.1").count() for n in (
        "i2_list_items", "i2_list_items_undated", "i2_list_all_items", "i2_list_all_undated")}
    assert small == {"i2_list_items": 1000, "i2_list_items_undated": 1000, "i2_list_all_items": 6304, "i2_list_all_undated": 9676}


def test_contents_of_two_languages_are_parsed(spark, tmp_path):
    rows = [(1, "de", "same"), (2, "fr", "same"), (3, "de", "old"), (4, "en", "new"), (5, "en", None)]
    got = query(spark, "j5_to_parse", tmp_path, documents=(rows, "doc_id bigint, lang string, text string"))
    assert sorted(r.sha256 for r in got) == sorted(md5(x.encode()).hexdigest() for x in ("old", "new"))


def test_live_medians_are_exact(spark):
    at = datetime(2026, 1, 1, 12)
    n = 30_000
    parts = [[(at, (i * i) % 1_000_003) for i in range(n)] + [(at, None)], [(datetime(2027, 1, 1), None)]]
    stream = stream_of(spark, parts, "ts timestamp, latency_ms bigint", "medians")
    out = feeds.daily_trend(feeds.run_available(feeds.live_daily(stream), "medians")).collect()
    assert [(r.questions, r.median_ms) for r in out] == [(n + 1, sorted((i * i) % 1_000_003 for i in range(n))[n // 2 - 1])]


def test_small_cells_are_visited_by_bins(spark):
    ensure_checkpoint_dir(spark)
    rows = spark.range(1500).select("id", F.array(*[F.randn(i) for i in range(8)]).alias("vec"), F.lit("").alias("part")).checkpoint()
    tree = nearest.CellTree(rows, 10)
    opened = tree.visits(rows.limit(50).withColumn("_kth", F.lit(-2.0)), None).groupBy("id").count()
    assert 1 < opened.agg(F.max("count")).first()[0] <= 3 * nearest.BINS
    assert tree.leaves.count() == 1500


def test_a_code_of_many_chunks_costs_no_neighbours(spark):
    """Candidates come from every cell and stretch of chunks, so a larger table has no fewer of them a chunk."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(6000, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vec array<float>")
    chunks = rows.withColumnRenamed("id", "chunk_id")
    asked = rows.filter("id < 200").withColumnRenamed("id", "question_id")
    got = {}
    for r in nearest.ann_topk(asked, chunks, 10, n_probe=16, n_cells=16, exclude_self=True, refine=2).collect():
        got.setdefault(r.question_id, set()).add(r.chunk_id)
    scores = np.round(v[:200].astype(float) @ v.astype(float).T, 6)
    scores[np.arange(200), np.arange(200)] = -2
    want = {i: set(np.lexsort((np.arange(6000), -scores[i]))[:10].tolist()) for i in range(200)}
    assert sum(len(got[i] & want[i]) for i in want) / 2000 >= 0.9


@pytest.mark.parametrize("scale", [1.0, 1e20])
def test_blocks_give_only_what_reaches_the_kth_score(scale):
    """Scores are double, near ties go by them, and a block forwards nothing below the k-th score of the first pass."""
    rng = np.random.default_rng(3)
    c = rng.normal(size=(9000, 8))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    c[4000:4400] = c[0] + rng.normal(size=(400, 8)) * 3e-6
    q = np.concatenate([c[:2], rng.normal(size=(300, 8)) / 3])
    q, c = q * scale, c / scale ** 2
    digits = 6 if scale == 1 else 26
    scores = np.round(q @ c.T, digits)
    order = np.lexsort((np.broadcast_to(np.arange(9000), scores.shape), -scores), axis=1)[:, :5]
    want = [(i, j, scores[i, j]) for i in range(len(q)) for j in order[i].tolist()]
    chunks = pa.table({"id": np.arange(9000), "vec": list(c)})
    asked = pa.table({"id": np.arange(len(q)), "vec": list(q)})

    def rows(table):
        return [(x["question_id"], x["chunk_id"], pytest.approx(x["score"], rel=1e-9, abs=10.0 ** -digits)) for x in table.to_pylist()]

    kernel = nearest._topk_kernel(5, digits, False)
    assert rows(kernel(asked, chunks)) == want
    if scale == 1:
        third = np.array([scores[i, order[i, 2]] for i in range(len(q))])
        assert rows(kernel(asked.append_column("_kth", pa.array(third)), chunks)) == [x for x in want if x[2] >= third[x[0]]]


def kept_rows(spark, monkeypatch):
    """Rows of each frame that is checkpointed from now on."""
    kind, rows = type(spark.range(1)), []
    plain = kind.checkpoint

    def counted(df, *args):
        out = plain(df, *args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(kind, "checkpoint", counted)
    return rows


def test_questions_and_blocks_make_no_table(spark, monkeypatch):
    rows = kept_rows(spark, monkeypatch)
    chunks = spark.range(300).selectExpr("id AS chunk_id", "concat('a b c', repeat(' d', int(id % 7))) AS text")
    asked = [[x, f"e{i}"] for i in range(40) for x in "abcd"]
    q = spark.createDataFrame(list(enumerate(asked)), "question_id bigint, terms array<string>")
    hits = lexical.lexical_topk(q, lexical.block_postings(chunks, block=4), 2).collect()
    assert sorted((r.question_id, r.chunk_id, r.lex_score) for r in hits) == sorted(
        (i, c, n) for i in range(160) for c, n in (((6, 6), (13, 6)) if i % 4 == 3 else ((0, 1), (1, 1))))
    assert max(rows) <= 3 * 2 * 160


def test_shards_forward_only_what_is_better(spark, monkeypatch):
    """Chunks of equal score in many shards are not sent on by each of them."""
    search, forwarded = lexical._search, []

    def counted(*args):
        out = search(*args).checkpoint()
        forwarded.append(out.count())
        return out

    monkeypatch.setattr(lexical, "_search", counted)
    monkeypatch.setattr(lexical, "SHARD", 30)
    ensure_checkpoint_dir(spark)
    chunks = spark.range(300).selectExpr("id AS chunk_id", "concat('a b c', repeat(' d', int(6 - id % 7))) AS text")
    q = spark.createDataFrame([(i, ["a", f"e{i}"]) for i in range(40)], "question_id bigint, terms array<string>")
    hits = lexical.lexical_topk(q, lexical.block_postings(chunks, block=4), 2).collect()
    assert sorted((r.question_id, r.rank, r.chunk_id, r.lex_score) for r in hits) == [(i, r, r - 1, 1) for i in range(40) for r in (1, 2)]
    assert sum(forwarded) <= 40 * 2 * 8


def test_postings_are_read_once_for_reranking(spark):
    read = spark.sparkContext.accumulator(0)

    def words(text):
        read.add(1)
        return text

    text = F.udf(words)("text")
    chunks = spark.createDataFrame([(i, f"w{i} all") for i in range(10)], "chunk_id bigint, text string").repartition(1)
    q = spark.createDataFrame([(1, ["w3", "all"])], "question_id bigint, terms array<string>")
    hits = q.select("question_id", F.lit(3).cast("bigint").alias("chunk_id"))
    index = lexical.postings(chunks.select("chunk_id", text.alias("text")))
    assert fusion.overlap_logits(hits, q, index, chunks.agg(F.count("*").alias("n"))).collect()[0].logit == 4.0
    assert read.value == 10


def test_spelt_words_are_found_in_runs_of_short_units():
    for text in ("", "a b c", "so a b c d it x", "long a\tb  c long x y zz a b\nc", "ab a b cd e f g"):
        single = [x for run in deobfuscation._SHORT.findall(text) for x in deobfuscation.spaced_words(run)]
        assert single == deobfuscation.spaced_words(text)
