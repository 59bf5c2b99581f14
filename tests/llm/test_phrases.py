"""Collocations against plain counting; ranks, tiles and filters must not change a result."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import phrases

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, phrase string, code string, n string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", "c", "n", "r") for i, (lang, t) in enumerate(rows)], DOCS)


def plain(rows, top=2_000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(AZ)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= 10:
            found[lang, p] = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
    longer = Counter()
    for lang, p in found:
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                longer[lang, q] = max(longer[lang, q], f[lang, p])
    out = []
    for lang in n:
        own = [(-score, -f[lang, p], " ".join(p).encode(), p, k) for (g, p), (score, k) in found.items()
               if g == lang and not (len(p) == 2 and 100 * longer[lang, p] >= 50 * f[lang, p])]
        for rank, (score, a, phrase, p, k) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, f[lang, p[:k]], f[lang, p[k:]], n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["the", "of", "New", "york", "city", "a\x00b", "é", "İx", "q\x1cr", "nbsp\xa0x", "rare", "Big"] + [f"w{k}" for k in range(30)]
    out = []
    for k in range(400):
        picked = [rng.choice(words[:12] if rng.random() < 0.6 else words) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b", "?!"]) for w in picked)
        out.append((rng.choice(["en", "en", "fr", None, "und", ""]), text))
    return out + [("en", None), ("en", ""), ("fr", " \t\n.,"), ("en", "new york city " * 40_000), ("long", ("z" * 300 + " y ") * 12)]


@pytest.mark.parametrize("ranked, dense, held", [(1 << 17, 1 << 14, 500_000), (9, 4, 40), (0, 1, 10)])
def test_collocations(spark, rows, monkeypatch, ranked, dense, held):
    monkeypatch.setattr(phrases, "RANKED", ranked)
    monkeypatch.setattr(phrases, "DENSE", dense)
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "RUN", 2_000 if held < 50 else 4 << 20)
    got = phrases.collocations(frame(spark, rows)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_top_and_empty(spark, rows):
    got = phrases.collocations(frame(spark, rows), 3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain(rows, 3)
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(None, None)])).collect() == []


def test_scores_are_exact(spark):
    rows = [(3_000_000_001, 3_000_000_001, 3_000_000_007), (10**13, 10**13 + 1, 10**13 + 3), (10, 10, 10)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases._score("l", "r").alias("s"))
    assert all(x["s"] == 1_000_000 * x["a"] ** 2 // (x["l"] * x["r"]) for x in df.collect())


@pytest.mark.parametrize("dense", [1, 50, 1 << 14])
def test_tiles(monkeypatch, dense):
    monkeypatch.setattr(phrases, "DENSE", dense)
    rng = np.random.default_rng(1)
    left, right = (rng.zipf(1.3, 20_000) % 5_000 for _ in range(2))
    got = {(a, b): n for a, b, n in zip(*(x.tolist() for x in phrases.count_tiles(left, right)))}
    assert got == Counter(zip(left.tolist(), right.tolist()))
    assert all(len(x) == 0 for x in phrases.count_tiles(left[:0], right[:0]))
