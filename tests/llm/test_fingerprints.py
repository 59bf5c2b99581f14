"""Edit fingerprints against plain walks, edited texts against a plain loop, near-copies against known groups."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import fingerprints as fp

DOCS = "doc_id long, text string, lang string, range string, copy string, fingerprint string, key string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "r", "c", "f", "k") for i, t in zip(ids, texts)], DOCS)


def babble(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def plain_embedding(text, walk):
    """The walk step by step: the character written at each step, until the text ends."""
    moves = (fp.random64(fp.PERIOD * 4, 71 + walk).view(np.uint8)[:, None] >> np.arange(8, dtype=np.uint8) & 1).reshape(256, fp.PERIOD)
    codes, out, at, i = fp.classes(text), [], 0, 0
    while at < len(codes):
        out.append(codes[at])
        at += int(moves[codes[at], i % fp.PERIOD])
        i += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab cé\U0001F600\x00", max_size=300), min_size=1, max_size=8))
def test_walks_equal_the_plain_embedding(texts):
    for text, own in zip(texts, fp.fingerprints(texts)):
        for w, (length, symbols) in enumerate(own.walks):
            written = plain_embedding(text, w)
            assert length == len(written)
            assert symbols.tolist() == [written[s] for s in fp.sampled(length, w)]


def test_walks_side_by_side_equal_walks_alone(monkeypatch):
    rng = random.Random(3)
    texts = [babble(rng, n) for n in [0, 1, 5, 40, 40, 300, 700] * 5]
    alone = [str(fp.fingerprint(t)) for t in texts]
    monkeypatch.setattr(fp, "ALONE", 2)
    assert [str(p) for p in fp.fingerprints(texts)] == alone
    assert [str(fp.Print.parse(x)) for x in alone] == alone


def test_samples_of_two_lengths_are_nested():
    for short, long in [(10, 5000), (3000, 3001), (128, 129), (7, 7), (40_000, 100_000)]:
        reached = [s for s in fp.sampled(long, 0) if s < short]
        assert reached == fp.sampled(short, 0)[:len(reached)].tolist()


def test_likeness_falls_with_edits():
    rng = random.Random(7)
    near, far, cut = [], [], []
    for _ in range(40):
        text = babble(rng, 300)
        edited = list(text)
        for _ in range(3):
            edited[rng.randrange(len(edited))] = rng.choice(["", "q", "zz"])
        near.append(fp.fingerprint(text).likeness(fp.fingerprint("".join(edited))))
        far.append(fp.fingerprint(text).likeness(fp.fingerprint(babble(rng, 300))))
        cut.append(fp.fingerprint(text).likeness(fp.fingerprint(text[:len(text) * 2 // 3])))
    assert np.median(near) > 0.9 and max(far) < 0.35 and 0.5 < min(cut) and max(cut) < 0.85
    empty = fp.fingerprint(None)
    assert empty.likeness(fp.fingerprint("")) == 1 and empty.likeness(fp.fingerprint("a")) == 0


def plain_pairs(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    out = []
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        m = len(text) // 3
        edited = text[:len(text) - m] + after[:m]
        a, b, c = map(fp.fingerprint, (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(c)))
    return out


@pytest.mark.parametrize("rows", [3, 4_000])
def test_edited_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows)
    rng = random.Random(11)
    texts = [babble(rng, n) for n in (1, 2, 30, 30, 400, 3, 60)] + [None, "", "é\U0001F600" * 9, "x" * 3_000_000, "twin", "twin", None, "z"]
    ids = [5, 900, 3, 77, 12, -4, 8, 1, 2, 33, 34, 40, 40, 41, None]
    got = fp.edited_pairs(frame(spark, texts, ids)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert Counter(map(tuple, got)) == Counter(plain_pairs(list(zip(ids, texts))))


def test_edited_pairs_of_few_rows(spark):
    assert fp.edited_pairs(frame(spark, [])).collect() == []
    (row,) = fp.edited_pairs(frame(spark, ["abcdef"])).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1
    assert len(fp.edited_pairs(frame(spark, ["a", None], [None, None])).collect()) == 2


@pytest.mark.parametrize("block", [20_000, 4])
def test_near_documents(spark, monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK_ROWS", block)
    rng = random.Random(2)
    texts, group = [], []
    for g in range(12):
        base = babble(rng, 250)
        for c in range(12 if g == 0 else 3):
            edited = list(base)
            for _ in range(c and 2):
                edited[rng.randrange(len(edited))] = rng.choice(["", "q", "zz"])
            texts.append("".join(edited))
            group.append(g)
    texts += [None, "", "a", "a", "b"]
    group += [100, 100, 101, 101, 102]
    rows = {r["doc_id"]: r for r in fp.near_documents(frame(spark, texts)).collect()}
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    wrong = sum(rows[i]["component_id"] != first[g] for i, g in enumerate(group))
    assert wrong <= 2 and all(group[rows[i]["component_id"]] == g for i, g in enumerate(group))
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())
    assert rows[len(texts) - 5]["component_id"] == rows[len(texts) - 4]["component_id"] == len(texts) - 5
    assert fp.near_documents(frame(spark, [])).collect() == []
    assert [r["component_id"] for r in fp.near_documents(frame(spark, ["t"], [None])).collect()] == [None]
