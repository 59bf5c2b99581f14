"""Catalogue state, remote plans, enrichment, vocabulary, labels, on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog as C
from lectern.operators import enrichment as E
from lectern.operators import history as H
from lectern.operators import remote as S
from lectern.operators import vocabulary as V


def test_plan_ingest(spark):
    files = spark.createDataFrame([("a.txt", "1"), ("b.txt", "2"), ("c.txt", "3"), ("d.txt", "4"), ("e.txt", "5")], "path string, sha256 string")
    cat = spark.createDataFrame([("a.txt", "1", "ok", 4), ("b.txt", "old", "ok", 4), ("c.txt", "3", "error", 4), ("d.txt", "4", "ok", 3), ("e.txt", "5", "ok", 4),
                                 ("gone.txt", "9", "ok", 4)], "path string, sha256 string, status string, parser_version int")
    out = spark.createDataFrame([("e.txt",)], "path string")
    got = {r.path: r.result for r in C.plan_ingest(files, cat, out).collect()}
    assert got == {"a.txt": "skipped", "b.txt": "ingest", "c.txt": "ingest", "d.txt": "ingest", "e.txt": "excluded"}
    forced = {r.path: r.result for r in C.plan_ingest(files, cat, out, force=True).collect()}
    assert forced["a.txt"] == "ingest" and forced["e.txt"] == "excluded"
    assert {r.path for r in C.gone(cat, C.plan_ingest(files, cat, out)).collect()} == {"e.txt", "gone.txt"}


def test_prefix_is_a_folder(spark):
    cat = spark.createDataFrame([("Prob/a.txt",), ("Prob/x/b.txt",), ("Prob 2/c.txt",), ("Prob",)], "path string")
    folders = spark.createDataFrame([("Prob",)], "folder string")
    assert {r.path for r in C.remove_prefix(cat, folders).collect()} == {"Prob 2/c.txt", "Prob"}


def test_plan_sync(spark):
    remote = spark.createDataFrame([("k1", "o/a.pdf", "m1", None), ("k2", "o/b.pdf", "m2", None), ("k3", "o/c.pdf", "m3", None), ("k4", "o/d.pdf", "m", None),
                                    ("k5", "o/e.pdf", "m", None), ("k6", "o/n.md", "m", "t2")], "key string, target string, modified string, text_sha string")
    state = spark.createDataFrame([("k1", "o/a.pdf", "m1"), ("k2", "o/b.pdf", "old"), ("k3", "o/c.pdf", "m3"), ("k6", "o/n.md", "m")], "key string, path string, modified string")
    local = spark.createDataFrame([("o/a.pdf", "1"), ("o/b.pdf", "2"), ("o/d.pdf", "3"), ("o/n.md", "t1")], "path string, sha string")
    got = {r.key: r.action for r in S.plan_sync(remote, state, local).collect()}
    assert got == {"k1": "unchanged", "k2": "changed", "k3": "deleted_locally", "k4": "adopt", "k5": "new", "k6": "changed"}


def test_match_folders(spark):
    rows = [("1", "Probability 2__5DS1", "X"), ("2", "PROBABILITY 2", "X"), ("3", "Basket weaving", "X"), ("4", "Basket weaving", "Y"), ("5", "Probabilty 2", "X")]
    courses = spark.createDataFrame(rows, "id string, name string, course_id string")
    folders = spark.createDataFrame([("Probability 2",), ("DEVOPS",)], "folder string")
    over = spark.createDataFrame([("4", "DEVOPS")], "key string, folder string")
    got = {r.id: r.folder for r in S.match_folders(courses, folders, over).collect()}
    assert got == {"1": "Probability 2", "2": "Probability 2", "3": None, "4": "DEVOPS", "5": "Probability 2"}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_close_names_against_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 24))).strip() or "a" for _ in range(40)]
    names = []
    for b in base:
        s = list(b)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s) + 1)
            op = rng.choice("ids")
            if op == "i":
                s.insert(i, rng.choice("abcd"))
            elif s and i < len(s):
                s[i:i + 1] = [] if op == "d" else [rng.choice("abcd")]
        names.append("".join(s) or "b")
    got = {r.name: round(r.ratio, 9) for r in S.close_names(
        spark.createDataFrame([(n,) for n in set(names)], "name string"), spark.createDataFrame([(b,) for b in set(base)], "target string")).collect()}
    want = {}
    for n in set(names):
        best = max(1 - edit_distance(n, b) / max(len(n), len(b)) for b in base)
        if best >= 0.85 - 1e-9:
            want[n] = round(best, 9)
    assert got == want and len(want) > 10


def test_latest_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "id string, seq int, v string")
    assert {(r.id, r.v) for r in S.latest_by_key(df, "id", "seq").collect()} == {("a", "z"), ("b", "q")}


def test_clean_enrichment(spark):
    rows = [(1, "  A summary. ", ["Gradient  descent", "gradient descent", "", "Loss"], ["Optimization", "Stochastic  GD", "x" * 41, "optimization"]),
            (2, "  ", ["a"], ["b"]), (3, "s", None, ["b"])]
    df = spark.createDataFrame(rows, "id int, summary string, concepts array<string>, tags array<string>")
    got = {r.id: r for r in E.clean_enrichment(df).collect()}
    assert (got[1].summary, got[1].concepts, got[1].tags) == ("A summary.", ["Gradient descent", "Loss"], ["optimization", "stochastic gd"])
    assert got[2].status == got[3].status == "error" and got[2].summary is None
    many = spark.createDataFrame([(1, "s", [f"c{i}" for i in range(30)], [f"t{i}" for i in range(30)])], df.schema)
    r = E.clean_enrichment(many).first()
    assert (len(r.concepts), len(r.tags)) == (10, 8)


def test_map_reduce_calls(spark):
    chunks = spark.createDataFrame([(1, i, f"Sentence number {i} of part.", 2500) for i in range(20)] + [(2, 0, "Only one. Short one.", 10)],
                                   "doc_id int, ord int, text string, n_tokens int")
    got = {r.doc_id: r for r in E.summarise(chunks).collect()}
    assert (got[1].calls, got[2].calls) == (24, 1) and got[2].summary == "Only one. Short one."

    def broken(texts):
        raise RuntimeError("no model")

    got = E.summarise(chunks, broken).collect()
    assert {r.status for r in got} == {"error"} and all(r.summary is None for r in got)
    seen = E.summarise(chunks, lambda ts: [t.upper() for t in ts]).filter("doc_id = 2").first()
    assert seen.summary == "ONLY ONE. SHORT ONE."


def test_chunks_to_summarise_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    chunks = spark.createDataFrame([(d, i, f"Part {i} of {d}.", 900) for d in range(4) for i in range(7)] + [(None, 0, "No document.", 1)],
                                   "doc_id int, ord int, text string, n_tokens int")
    got = {r.doc_id: r for r in E.summarise(chunks.mapInPandas(counted, chunks.schema), lambda ts: ts).collect()}
    assert made.value == 29 and set(got) == {0, 1, 2, 3}
    assert got[3].calls == 5 and got[3].summary == "\n\n".join(f"Part {i} of 3." for i in range(7))


def greedy(tags, new, threshold):
    """The sequential rule, course by course."""
    out = {}
    for course in {c for c, *_ in new}:
        known = [(str(i), np.array(v)) for i, c, v in sorted(tags, key=lambda t: t[0]) if c == course]
        for _, raw, freq, v in sorted((n for n in new if n[0] == course), key=lambda n: (-n[2], n[1])):
            sims = [round(float(np.dot(k, v)), 6) for _, k in known]
            if sims and max(sims) >= threshold:
                out[course, raw] = known[int(np.argmax(sims))][0]
            else:
                out[course, raw] = raw
                known.append((raw, np.array(v)))
    return out


@pytest.mark.parametrize("block", [2048, 8])
def test_vocab_pass_against_the_sequential_rule(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 8))

    def vec(i):
        v = centres[i % 5] + 0.35 * rng.normal(size=8)
        return (v / np.linalg.norm(v)).tolist()

    tags = [(i, c, vec(i)) for i, c in enumerate(["x", "x", None, "y"])]
    # course x holds most tags, forty of them with the very same vector
    same = vec(2)
    new = ([("x", f"t{i:03d}", int(rng.integers(1, 5)), vec(i)) for i in range(60)] + [("x", f"s{i:02d}", int(rng.integers(1, 5)), same) for i in range(40)]
           + [(None, f"n{i}", 1, vec(i)) for i in range(15)] + [("y", "only", 1, vec(3))])
    t = spark.createDataFrame(tags, "tag_id bigint, course string, vec array<double>")
    n = spark.createDataFrame(new, "course string, raw string, freq bigint, vec array<double>")
    got = {(r.course, r.raw): r.tag for r in V.vocab_pass(t, n, 0.85, block).collect()}
    assert got == greedy(tags, new, 0.85)
    assert len({v for (c, _), v in got.items() if c == "x"}) > 3


def test_vocabulary_example(spark):
    axis = np.eye(3)
    group = {"kubernetes": 0, "k8s": 0, "docker": 1, "ci/cd": 2, "continuous integration": 2}
    docs = spark.createDataFrame([(1, "DEVOPS", ["kubernetes", "docker"], "ok"), (2, "DEVOPS", ["kubernetes", "ci/cd"], "ok"),
                                  (3, "DEVOPS", ["k8s", "continuous integration"], "ok")], "doc_id int, course string, raw_tags array<string>, enrich_status string")
    none = spark.createDataFrame([], "course string, raw string, tag_id string")
    new = V.new_raw_tags(docs, none)
    assert [(r.raw, r.freq) for r in new.collect()] == [("kubernetes", 2), ("ci/cd", 1), ("continuous integration", 1), ("docker", 1), ("k8s", 1)]
    vecs = spark.createDataFrame([(k, axis[i].tolist()) for k, i in group.items()], "raw string, vec array<double>")
    passed = V.vocab_pass(spark.createDataFrame([], "tag_id bigint, course string, vec array<double>"), new.join(vecs, "raw"), 0.85)
    aliases = passed.select("course", "raw", F.col("tag").alias("tag_id"))
    assert passed.filter("created").count() == 3
    links = V.relink(docs, aliases)
    tags = passed.filter("created").select(F.col("tag").alias("tag_id"), "course", F.col("tag").alias("name"), F.lit(False).alias("user_named"))
    assert {r["name"]: r["count"] for r in V.list_tags(tags, links, aliases).collect()} == {"kubernetes": 3, "docker": 1, "ci/cd": 2}
    assert V.new_raw_tags(docs, aliases).count() == 0 and V.missed_modules(docs, aliases).count() == 0


def test_null_course_is_a_group(spark):
    docs = spark.createDataFrame([(1, None, ["a", "a", "b"], "ok"), (2, "x", ["a"], "ok"), (3, None, ["a"], "error")],
                                 "doc_id int, course string, raw_tags array<string>, enrich_status string")
    aliases = spark.createDataFrame([(None, "a", 1), ("x", "a", None), (None, "b", 2)], "course string, raw string, tag_id int")
    assert {(r.doc_id, r.tag_id) for r in V.relink(docs, aliases).collect()} == {(1, 1), (1, 2)}
    assert V.new_raw_tags(docs, aliases).count() == 0


def test_merge_labels(spark):
    m = "map<string,boolean>"
    current = spark.createDataFrame([(1, 1, {"1": True, "2": False}), (2, None, None), (3, -1, {"1": True})], f"id int, feedback int, relevant {m}")
    edits = spark.createDataFrame([(1, 1, False, None, {"2": None}), (2, 1, True, 1, {"4": True}), (2, 2, True, None, None), (3, 1, False, None, {"1": None})],
                                  f"id int, seq int, set_feedback boolean, feedback int, relevant {m}")
    got = {r.id: (r.feedback, r.relevant) for r in H.merge_labels(current, edits).collect()}
    assert got == {1: (1, {"1": True}), 2: (None, {"4": True}), 3: (-1, None)}


def test_history_page_is_clamped(spark):
    log = spark.range(300).select("id", F.lit("c").alias("course"), F.lit("50% off_x").alias("question"), F.lit("a").alias("answer"))
    assert H.history(log, limit=0).count() == 1 and H.history(log, limit=999).count() == H.history(log, limit=None).count() == log.count()
    assert [r.id for r in H.history(log, before=5, limit=2).collect()] == [4, 3]
    assert H.history(log, q="50%").count() == 50 and H.history(log, q="5_%").count() == 0


def test_tree_of_many_levels(spark):
    """A chain of 300 levels, an unavailable branch, an orphan, a circle, two roots."""
    from lectern.operators import remote as R

    chain = [(i, i - 1 if i else None, f"t{i}", True) for i in range(300)]
    rows = chain + [(1000, 10, "hidden", False), (1001, 1000, "below", True), (1002, 5000, "orphan", True), (1003, 1004, "a", True),
                    (1004, 1003, "b", None), (1005, None, "root", None), (1006, 1005, "leaf", None), (1007, 1007, "self", True)]
    got = {r.id: r for r in R.flatten_tree(spark.createDataFrame(rows, "id int, parent_id int, title string, available boolean")).collect()}
    assert set(got) == set(range(300)) | {1005, 1006}
    assert got[299].folders == [f"t{i}" for i in range(299)] and got[299].depth == 299 and got[0].folders == []
    assert got[1006].folders == ["root"]
    assert R.flatten_tree(spark.createDataFrame([], "id int, parent_id int, title string, available boolean")).collect() == []


def test_exact_median(spark):
    import random
    from statistics import median

    from lectern.operators.scan import exact_median

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-50, 20_000, 7)])) for _ in range(999)] + [("one", 5), ("two", 1), ("two", 4), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    want = {k: median([v for v in own if v is not None]) for k, own in want.items() if any(v is not None for v in own)}
    assert {r.k: r.m for r in exact_median(df, ["k"], "v", "m", 64).collect()} == want
    assert exact_median(df, [], "v", "m").first().m == median([v for _, v in rows if v is not None])
    assert [r.m for r in exact_median(df.limit(0), [], "v", "m").collect()] == [None] and exact_median(df.limit(0), ["k"], "v", "m").collect() == []
