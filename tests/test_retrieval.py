"""Search operators against brute force and known cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import answers as A
from lectern.operators import embedding as M
from lectern.operators import evaluation as E
from lectern.operators import fusion as R
from lectern.operators import lexical as L
from lectern.operators import nearest as N
from lectern.operators import usage as U


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def table(spark, m, name, **extra):
    rows = [(i, v.tolist(), *[e[i] for e in extra.values()]) for i, v in enumerate(m)]
    cols = "".join(f", {k} string" for k in extra)
    return spark.createDataFrame(rows, f"{name} bigint, vec array<double>{cols}")


def brute(q, c, k, mask=None):
    s = np.round(q @ c.T, 6)
    if mask is not None:
        s = np.where(mask, s, -np.inf)
    out = {}
    for i, row in enumerate(s):
        order = np.lexsort((np.arange(len(row)), -row))[:k]
        out[i] = [(int(j), float(row[j])) for j in order if row[j] > -np.inf]
    return out


def found(df):
    out = {}
    for r in df.orderBy("question_id", "rank").collect():
        out.setdefault(r.question_id, []).append((r.chunk_id, r.score))
    return out


@pytest.fixture(scope="module")
def clustered():
    """Three tight clusters and a hot group of copies that holds a third of the chunks."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    c = centres[rng.integers(0, 6, 400)] + 0.15 * rng.normal(size=(400, 16))
    c = np.vstack([c, np.tile(c[0], (200, 1))])
    q = centres[rng.integers(0, 6, 40)] + 0.2 * rng.normal(size=(40, 16))
    return unit(q), unit(c)


@pytest.mark.parametrize("cell_size,block", [(10_000, 2048), (60, 32), (100, 64)])
def test_dense_topk_is_exact(spark, clustered, cell_size, block):
    q, c = clustered
    got = N.dense_topk(table(spark, q, "question_id"), table(spark, c, "chunk_id"), 7, block=block, cell_size=cell_size)
    assert found(got) == brute(q, c, 7)


def test_dense_topk_returns_all_when_k_is_large(spark, clustered):
    q, c = clustered
    got = N.dense_topk(table(spark, q[:3], "question_id"), table(spark, c[:50], "chunk_id"), 80, block=16, cell_size=10)
    assert found(got) == brute(q[:3], c[:50], 80)


def test_scope_is_applied_before_the_search(spark, clustered):
    q, c = clustered
    qs, cs = ["a" if i % 2 else "b" for i in range(len(q))], ["a" if i < 30 else "b" for i in range(len(c))]
    got = N.dense_topk(table(spark, q, "question_id", course=qs), table(spark, c, "chunk_id", course=cs), 5,
                       scope="course", block=32)
    assert found(got) == brute(q, c, 5, np.array(qs)[:, None] == np.array(cs)[None, :])


def test_ann_recall(spark, clustered):
    q, c = clustered
    got = found(N.ann_topk(table(spark, q, "question_id"), table(spark, c[:400], "chunk_id"), 10, n_probe=3, n_cells=8))
    want = brute(q, c[:400], 10)
    hit = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hit / sum(len(v) for v in want.values()) >= 0.9


def test_doc_boost(spark):
    axis = np.eye(3)
    chunk = [[0.9, 0.436, 0.0], [0.85, 0.0, 0.527]]
    q = table(spark, axis[:1], "question_id")
    chunks = spark.createDataFrame([(0, chunk[0], 10), (1, chunk[1], 11)], "chunk_id bigint, vec array<double>, doc_id int")
    docs = spark.createDataFrame([(10, axis[1].tolist()), (11, axis[0].tolist())], "doc_id int, vec array<double>")
    hits = N.dense_topk(q, chunks, 5).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    for boost, order in ((0.0, [0, 1]), (0.1, [1, 0])):
        rows = N.doc_boost(hits, q, docs, boost, 5).orderBy("rank").collect()
        assert [r.chunk_id for r in rows] == order
        assert {r.chunk_id: round(r.score, 2) for r in rows} == {0: 0.9, 1: 0.85}
    used = N.doc_boost(hits, q, docs, 0.1, 5).filter("score >= 0.88").collect()
    assert [r.chunk_id for r in used] == [0]


def test_lexical_topk(spark):
    chunks = spark.createDataFrame([(1, "loi loi normale"), (2, "loi"), (3, "autre"), (4, "normale loi")], "chunk_id bigint, text string")
    q = spark.createDataFrame([(1, ["loi", "normale"]), (2, ["loi", "normale"]), (3, []), (4, ["absent"])],
                              "question_id bigint, terms array<string>")
    got = L.lexical_topk(q, L.block_postings(chunks), 2).orderBy("question_id", "rank").collect()
    want = [(1, 3, True), (4, 2, True)]
    assert [(r.question_id, r.chunk_id, r.lex_score, r.all_terms) for r in got] == [(i, *w) for i in (1, 2) for w in want]


def plain_cover_density(places):
    at = sorted((int(p), t) for t, own in enumerate(places) for p in own)
    spans = []
    for i in range(len(at)):
        for j in range(i, len(at)):
            if len({t for _, t in at[i:j + 1]}) == len(places):
                spans.append((i, j))
                break
    least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sum(0.1 / (1 + at[j][0] - at[i][0] - (j - i)) for i, j in least)


def test_cover_density():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 5))
        at = rng.permutation(40)[:int(rng.integers(n, 15))]
        term = np.concatenate([np.arange(n), rng.integers(0, n, len(at) - n)])
        places = [np.sort(at[term == t]) for t in range(n)]
        assert L.cover_density(places) == pytest.approx(plain_cover_density(places))


@pytest.mark.parametrize("rank,block,scope", [("positions", 256, None), ("positions", 3, None), ("covers", 5, None), ("positions", 4, "lang")])
def test_lexical_topk_against_all_pairs(spark, rank, block, scope):
    """Long and short chunks, a hot term, ties, copies of questions; pruning must not change a row."""
    rng = np.random.default_rng(8)
    words = np.array(["hot"] * 6 + [f"w{i}" for i in range(25)])
    texts = [" ".join(rng.choice(words, int(rng.choice([0, 3, 10, 60, 300])))) for _ in range(120)]
    langs = [str(rng.choice(["a", "b"])) for _ in texts]
    asked = [list(dict.fromkeys(map(str, rng.choice(words, int(rng.integers(1, 4)))))) for _ in range(25)] + [["hot", "none"]]
    chunks = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))], "chunk_id bigint, text string, lang string")
    q = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(asked)], "question_id bigint, terms array<string>, lang string")
    index = L.block_postings(chunks, extra=("lang",) if scope else (), block=block)
    got = {}
    for r in L.lexical_topk(q, index, 6, scope, rank).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.chunk_id, round(r.lex_score, 9), r.all_terms))
    want = {}
    for i, terms in enumerate(asked):
        rows = []
        for c, t in enumerate(texts):
            places = [[p for p, w in enumerate(t.split()) if w == term] for term in terms]
            held = sum(map(bool, places))
            if held and (rank == "positions" or held == len(terms)) and (not scope or langs[c] == "ab"[i % 2]):
                score = sum(map(len, places)) if rank == "positions" else plain_cover_density(places)
                rows.append((-round(score, 9), c, held == len(terms)))
        if rows:
            want[i] = [(c, -s, a) for s, c, a in sorted(rows)[:6]]
    assert got == want


def test_rrf(spark):
    d = spark.createDataFrame([(1, c, s, r) for c, s, r in ((1, .9, 1), (2, .8, 2), (3, .7, 3))], "question_id int, chunk_id int, score double, rank int")
    x = spark.createDataFrame([(1, 3, .7, 1, True), (1, 4, .2, 2, False)], "question_id int, chunk_id int, score double, rank int, all_terms boolean")
    rows = R.rrf(d, x).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [3, 1, 2, 4]
    assert rows[0].rrf == pytest.approx(1 / 63 + 1 / 61) and (rows[0].dense_rank, rows[0].lex_rank) == (3, 1)
    assert rows[1].lex_rank is None and rows[1].all_terms is None
    assert R.answerable(R.rrf(d.filter("false"), x), 0.8).first().answerable
    assert not R.answerable(d.withColumn("score", F.lit(0.1))).first().answerable


def test_rerank_order_and_fallback(spark):
    hits = spark.createDataFrame([(q, c, 0.5, c) for q in (1, 2) for c in (1, 2, 3)], "question_id int, chunk_id int, score double, rank int")
    pairs = hits.withColumn("question", F.concat(F.lit("q"), "question_id")).withColumn("text", F.concat(F.lit("t"), "chunk_id"))

    def scorer(question, texts):
        if question == "q2":
            raise RuntimeError("no model")
        return [float(t[1:]) for t in texts]

    rows = R.rerank(hits, R.scored_by(pairs, scorer)).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.chunk_id) for r in rows] == [(1, 3), (1, 2), (1, 1), (2, 1), (2, 2), (2, 3)]
    assert rows[0].rerank_score == pytest.approx(1 / (1 + np.exp(-3))) and rows[0].dense_rank == 3
    assert rows[3].rerank_score is None


def test_embed_hooks(spark):
    df = spark.createDataFrame([("aa",), ("",)], "text string")
    rows = M.embed(df, embedder=lambda ts: [[len(t), 0.0] for t in ts]).collect()
    assert [r.vec for r in rows] == [[1.0, 0.0], [0.0, 0.0]]


def test_citations(spark):
    cases = [("B [3]. A [1]. B [3].", 3, "B [1]. A [2]. B [1].", [3, 1], [], True),
             ("x [7].", 3, "x.", [], [7], False), ("x [1, 3] y [3,5]", 4, "x [1][2] y [2]", [1, 3], [5], False),
             ("x [0].", 2, "x.", [], [0], False), ("none", 2, "none", [], [], False)]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "id int, answer string, n_sources int")
    for r in A.validate_citations(df).collect():
        _, _, text, cited, invalid, valid = cases[r.id]
        assert (r.text, r.cited, r.invalid, r.valid) == (text, cited, invalid, valid)


def test_claims(spark):
    df = spark.createDataFrame([(1, "A is B [1]. C is D [2] [3], so. E\nno cites here\n[4](x) [5]")], "id int, answer string")
    got = [(r.block, r.text, r.cites) for r in A.claims(df, ["id"]).orderBy("block", "ord").collect()]
    assert got == [(0, "A is B [1].", "1"), (0, " C is D [2] [3],", "2,3"), (0, " so. E", ""), (2, "[4](x) [5]", "5")]


def test_quotas(spark):
    def run(sizes, n):
        df = spark.createDataFrame(list(sizes.items()), "course string, size bigint")
        return {r.course: r.quota for r in E.quotas(df, n).collect()}

    q = run({"A": 100, "B": 10, "C": 3}, 30)
    assert q["C"] == 3 and q["B"] >= 5 and sum(q.values()) == 30
    assert run({"A": 100, "B": 100}, 4) == {"A": 2, "B": 2}
    assert run({"A": 3, "B": 2}, 50) == {"A": 3, "B": 2}


def test_reject_reason(one):
    passage = "the law of large numbers says that averages converge to the mean"
    r = E.reject_reason(F.col("q"), F.col("p"))
    assert one(r, q="", p=passage) == "empty"
    assert one(r, q="what is it", p=passage) == "too short"
    assert one(r, q="w " * 41, p=passage) == "too long"
    assert one(r, q="why do averages converge to the mean?", p=passage) == "copies the passage"
    assert one(r, q="what happens to averages of many samples?", p=passage) is None


def test_retrieval_metrics(spark):
    items = spark.createDataFrame([("dense", 1, False, True), ("dense", 7, False, True), ("dense", None, True, True),
                                   ("rerank", 1, False, True), ("rerank", None, False, None)], "mode string, rank int, refused boolean, available boolean")
    got = {r["mode"]: r for r in E.retrieval_metrics(items).collect()}
    d = got["dense"]
    assert (d.n, d.recall_1, d.recall_5) == (3, pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert (d.recall_20, d.mrr, d.refusal_rate) == (pytest.approx(2 / 3), pytest.approx((1 + 1 / 7) / 3), pytest.approx(1 / 3))
    assert got["rerank"].n == 0 and got["rerank"].unavailable and got["rerank"].mrr is None


def test_log_summary(spark):
    rows = [(1, "2026-09-28 10:00", "Prob", "x", True, 4000), (2, "2026-09-28 11:00", "Prob", A.NOT_FOUND, None, 1000),
            (3, "2026-09-28 12:00", None, "y", False, 9000), (4, "2026-09-28 13:00", "Prob", None, None, None),
            (5, "2026-08-20 10:00", "Prob", "z", True, 60000)]
    log = spark.createDataFrame(rows, "id int, t string, course string, answer string, citation_valid boolean, latency_ms int").withColumn(
        "ts", F.col("t").cast("timestamp_ntz"))
    now = "2026-09-29 12:00:00"
    s = U.log_summary(log, 7, now).first()
    assert tuple(s) == (4, 1, 1, 1, 4000, 9000)
    assert tuple(U.log_by_module(log, 7, now).first()) == ("Prob", 3, 1)
    everything = U.log_summary(log, 0, now).first()
    assert (everything.questions, everything.max_ms) == (5, 60000)
    edge = spark.createDataFrame([("2026-09-27 23:30:00", 5)], "t string, latency_ms int").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert [str(U.log_by_day(edge, 0, now, tz).first().day) for tz in ("UTC", "Africa/Tunis")] == ["2026-09-27", "2026-09-28"]


def test_one_model_for_all_texts(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "alpha gamma delta"), (4, None)], "id int, text string")
    model = M.fit_embedder(df)
    whole = {r.id: r.vec for r in M.embed(df, model=model).collect()}
    alone = {r.id: r.vec for i in (1, 2, 4) for r in M.embed(df.filter(f"id = {i}"), model=model).collect()}
    assert all(alone[i] == whole[i] for i in alone)
    assert abs(sum(x * x for x in whole[1]) - 1) < 1e-9 and not any(whole[4])
    single = M.embed(df.filter("id = 2")).first()
    assert abs(sum(x * x for x in single.vec) - 1) < 1e-9  # a term that every document holds still counts


def test_backfill_uses_the_stored_model(spark):
    rows = [(1, "s", "s", "ok", "alpha beta", [1.0]), (2, "s", "s", "ok", "gamma beta", None), (3, "s", "x", "ok", "old", None)]
    docs = spark.createDataFrame(rows, "doc_id int, sha256 string, enriched_sha string, enrich_status string, summary string, summary_vec array<double>")
    model = M.fit_embedder(docs, "summary")
    got = {r.doc_id: r.summary_vec for r in M.embed_missing(docs, model=model).collect()}
    want = M.embed(docs, "summary", model=model).filter("doc_id = 2").first()
    assert got[2] == want.vec and got[1] == [1.0] and got[3] is None
    assert {r.doc_id: r.summary_vec for r in M.embed_missing(docs).collect()}[2] == got[2]


def test_scorer_sees_a_question_whole(spark):
    pairs = spark.range(3000).selectExpr("id % 3 AS question_id", "id AS chunk_id", "concat('q', id % 3) AS question", "'t' AS text").repartition(7)
    got = R.scored_by(pairs, lambda q, texts: [float(len(texts))] * len(texts))
    assert {r.logit for r in got.collect()} == {1000.0}


def test_cells_of_cells(spark, clustered, monkeypatch):
    """Levels of cells, a hot group of copies, and scopes of very different size; results stay exact."""
    monkeypatch.setattr(N, "FAN", 5)
    q, c = clustered
    chunks = table(spark, c, "chunk_id", course=["a"] * 500 + ["b"] * 90 + ["c"] * 10)
    tree = N.CellTree(chunks.selectExpr("chunk_id AS id", "vec", "'' AS part"), 60)
    assert len(tree.levels) >= 2
    leaves = tree.leaves.groupBy("part").count().collect()
    assert sum(r["count"] for r in leaves) == 600 and sum(r["count"] > 60 for r in leaves) <= 1
    qt = table(spark, q, "question_id", course=["a"] * 20 + ["b"] * 15 + ["c"] * 5)
    assert found(N.dense_topk(qt, chunks, 7, block=16, cell_size=60)) == brute(q, c, 7)
    mask = np.array(["a"] * 20 + ["b"] * 15 + ["c"] * 5)[:, None] == np.array(["a"] * 500 + ["b"] * 90 + ["c"] * 10)[None, :]
    assert found(N.dense_topk(qt, chunks, 7, scope="course", block=16, cell_size=60)) == brute(q, c, 7, mask)
    assert N.dense_topk(qt, chunks.limit(0), 3).collect() == N.ann_topk(qt, chunks.limit(0), 3).collect() == []
