"""Bootstrapping against a plain loop; secrets and account numbers found through their contexts."""

import random
import re
from collections import defaultdict

from lectern.llm import pii

KINDS = pii.KINDS + pii.MORE


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, pattern string")


def plain_bootstrap(edges):
    graph = {(p, i) for p, i, _ in edges}
    known = {(i, k): 1.0 for _, i, k in edges if k}
    while True:
        of = defaultdict(list)
        for (i, k), w in known.items():
            of[i].append((k, w))
        accepted = {}
        for p in {p for p, _ in graph}:
            own = [i for q, i in graph if q == p]
            for kind in KINDS:
                mine = [w for i in own for k, w in of[i] if k == kind]
                other = [w for i in own for k, w in of[i] if k != kind]
                other += [pii.UNKNOWN if re.fullmatch(pii.SHAPES[kind], i) else 1.0 for i in own if not of[i]]
                if len(mine) >= pii.LEAST_KNOWN and sum(mine) / (sum(mine) + sum(other)) >= pii.CONFIDENCE:
                    accepted[p, kind] = sum(mine) / (sum(mine) + sum(other))
        new = {}
        for p, i in graph:
            for kind in KINDS:
                if (p, kind) in accepted and not of[i]:
                    new[i] = max(new.get(i, (0, "")), (accepted[p, kind], kind))
        if not new:
            return accepted
        known.update({(i, k): w for i, (w, k) in new.items()})


def test_rounds_equal_a_plain_loop(spark):
    rng = random.Random(6)
    shapes = {"phone": lambda: f"555 {rng.randint(1000, 1040)} 22", "secret": lambda: f"abc{rng.randint(100, 130)}def456x",
              "email": lambda: f"a{rng.randint(1, 30)}@b.c", "odd": lambda: f"?{rng.randint(1, 40)}"}
    kind_of, edges = {}, []
    for p in range(25):
        main = rng.choice(["phone", "secret", "email"])
        for _ in range(rng.randint(2, 12)):
            shape = main if rng.random() < 0.9 else rng.choice(list(shapes))
            i = shapes[shape]()
            kind_of.setdefault(i, shape if shape != "odd" and rng.random() < 0.5 else None)
            edges.append((f"p{p}", i, kind_of[i]))
    want = plain_bootstrap(edges)
    got = pii.bootstrap(spark.createDataFrame(edges, "pattern string, instance string, kind string")).collect()
    assert want and {(r["pattern"], r["kind"]): round(r["confidence"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_secrets_by_seeds_and_contexts(spark):
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(6)]
    texts = [f'Some words {i} here token = "{h}" and more' for i, h in enumerate(hexes)]
    texts += ['Other words token = "a1b2c3d4e5f6" end', "plain a1b2c3d4e5f6 text 1234567 here", "pay DE89 3704 0044 0532 0130 00 now",
              "pay DE88 3704 0044 0532 0130 00 now", "x" * 100_000 + ' key: "' + hexes[0] + '"', "word " * 30_000, None]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, texts)).collect()}
    for i, h in enumerate(hexes):
        at = texts[i].index(h)
        assert rows[i]["spans"] == f"secret:{at}:{at + 40}" and rows[i]["n_found"] == rows[i]["n_all"] == 1
    at = texts[6].index("a1b2")
    assert rows[6]["spans"] == f"secret:{at}:{at + 12}"  # unseen, by what stands before it
    assert rows[7]["spans"] == "" and rows[8]["spans"] == "iban:4:31" and rows[9]["spans"] == ""
    assert rows[10]["n_found"] == 1 and rows[11]["n_all"] == rows[12]["n_all"] == 0


def test_contexts_keep_signs_and_whole_words():
    text = f'{"w" * 500} token = "abc" end. Next'
    at = text.index("abc")
    found = pii.contexts(text, at, at + 3)
    assert {'" _', '= " _', 'token = " _', '_ " end', '" _ "'} <= set(found)
    assert pii.contexts("z" * 500 + " abc", 501, 504)[0] != pii.contexts("z" * 501 + " abc", 502, 505)[0]
