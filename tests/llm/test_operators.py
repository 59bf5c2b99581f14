"""Each operator against a plain version on small rows, with nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import chat, common, components, deobfuscation, exact, html, minhash, mixing, packing, pii, shingles, tokens, toxicity, vectors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _size string, component_id string, key string"


def frame(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, None, s, None, "x", None, "k") for i, t, s in zip(ids, texts, sources)], DOCS)


def babble(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "Ö", "x"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [babble(rng, n) for n in (1, 3, 4, 5, 6, 30, 60, 200, 200, 400)]
    out = list(base)
    for b in base:
        words = b.split()
        for _ in range(6):
            edited = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                edited[rng.randrange(len(edited))] = "edit"
            out.append(rng.choice([" ", "\n", "\t "]).join(edited))
        out += [b.upper(), b]
    return out + [None, "", "   \n", "x" * 3_000_000, "long " * 50_000, " a  b \x0b c", "a\x00b <|endoftext|> c"]


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---- personal data

def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@.%+-1289 0()é\n", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_digit_runs_take_linear_time():
    assert pii.base_spans("1" * 200_000 + " @" * 50_000 + "." * 50_000) == []


def test_contexts_find_unseen_identifiers(spark):
    known = [f"Filler w{i}q goes. Please ring phone number +1 (555) 010-{1000 + i} today {i % 7}x" for i in range(8)]
    new = ["Another one: please ring phone number 555-0199-22 today", "nothing here 123456 at all", None, ""]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, known + new)).collect()}
    assert [rows[i]["n_phone"] for i in range(8)] == [1] * 8 and all(rows[i]["n_found"] == 0 for i in range(8))
    text = new[0]
    start = text.index("555-")
    assert rows[8]["spans"] == f"phone:{start}:{start + 11}" and rows[8]["n_phone"] == 0 and rows[8]["n_found"] == 1
    assert rows[9]["spans"] == "" and rows[10]["base_sha256"] == rows[11]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(frame(spark, [])).collect() == []


def test_unseen_identifiers_are_no_errors(spark):
    known = [f"Filler w{i}q goes. Please ring phone number +1 (555) 010-{1000 + i} today {i % 7}x" for i in range(10)]
    unseen = ["555 123 4567", "(555) 010 2233", "555-0199-22", "555.019.9333"]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, known + [f"ring phone number {u} today" for u in unseen])).collect()}
    assert [rows[10 + i]["spans"] for i in range(4)] == [f"phone:18:{18 + len(u)}" for u in unseen]
    wrong = [f"ring phone number abc{i}-{1000 + i}q today" for i in range(4)]  # another shape contradicts
    rows = pii.find_personal_data(frame(spark, known + wrong)).collect()
    assert all(r["n_found"] == 0 for r in rows)
    text = "pay to DE89 3704 0044 0532 0130 00 now, or 123456 7, or 12 34"
    assert [text[a:b] for a, b, _ in pii.candidates(text, [])] == ["DE89 3704 0044 0532 0130 00", "123456 7", "123456"]


def test_bootstrap_runs_until_nothing_is_new(spark):
    edges = [(f"p{k}", f"555 123 {1000 + 3 * k + i}", "phone" if k == 0 else None) for k in range(6) for i in range(3)]
    edges += [(f"p{k + 1}", e, None) for k in range(6) for e in [x[1] for x in edges if x[0] == f"p{k}"]]
    accepted = pii.bootstrap(spark.createDataFrame(edges, "pattern string, instance string, kind string"))
    assert {r["pattern"] for r in accepted.collect()} == {f"p{k}" for k in range(7)}


def test_spans_of_repeated_rows(spark):
    rows = pii.find_personal_data(frame(spark, ["mail a@b.c or 1.2.3.4"] * 2 + [None], [7, 7, None])).collect()
    assert Counter(r["spans"] for r in rows) == {"email:5:10,ip:14:21": 2, "": 1}


# ---- near-duplicates

def test_estimate_misses_far_less_than_bands():
    n, least = shingles.SLOTS, int(minhash.ESTIMATE * shingles.SLOTS)
    missed = sum(math.comb(n, k) * 0.75 ** k * 0.25 ** (n - k) for k in range(least))
    assert missed < 0.001 * (1 - 0.75 ** shingles.ROWS) ** (n // shingles.ROWS)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_roots(texts):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(sets), links)


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates(spark, texts, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    sizes, want = near_roots(texts)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in got)


def test_near_duplicates_of_odd_ids(spark):
    text = "one two three four five six"
    rows = minhash.near_duplicates(frame(spark, [text, text, text, None, text], [5, 5, None, None, 3])).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == {
        (5, 3, False): 2, (None, 3, False): 1, (None, None, True): 1, (3, 3, True): 1}
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    kept = minhash.distinct_documents(frame(spark, [text, text + " seven", "", None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3] and kept.columns == frame(spark, []).columns


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.unique(pool[:300]), np.unique(pool[60:360])
        s = shingles.super_minhash([a, b])
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    one = shingles.super_minhash([np.array([7], np.uint64)])[0]
    assert sorted(one >> np.uint64(56)) == list(range(shingles.SLOTS))  # a single element takes every slot once


def test_words_of_long_texts_are_cut_at_white_space(monkeypatch):
    text = pa.array(["ab cd\tef  " * 50 + "x" * 300 + " end", "tail one two three four five"])
    want = [s.tolist() for run in shingles.shingle_sets(text) for s in run]
    monkeypatch.setattr(shingles, "_STEP", 64)
    assert [s.tolist() for run in shingles.shingle_sets(text) for s in run] == want


def test_signatures_take_little_memory_and_workers_give_it_back(monkeypatch):
    words = pa.array([" ".join(f"w{i * 300 + k}" for k in range(300)) for i in range(1500)])  # 3 MB
    shingles._power_tables(1)  # these stay
    tracemalloc.start()
    n = sum(len(shingles.super_minhash(sets)) for sets in shingles.shingle_sets(words))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1500 and peak < 24 << 20
    given_back = []
    monkeypatch.setattr(common, "give_back", lambda: given_back.append(True))
    task = common.keeping_nothing(lambda batches: (b for b in batches))(iter([1, 2]))
    given_back.clear()
    assert list(task) == [1, 2] and given_back


def test_candidates_and_their_stars_share_a_worker(spark):
    members = spark.createDataFrame([(1, b"a", 3, bytes(128)), (1, b"b", 3, bytes(128)), (1, b"c", 3, bytes(128)), (2, b"d", 3, bytes(128))],
                                    "band long, node binary, n_shingles long, sketch binary")
    edges = minhash.candidate_edges(members)
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = components.components(edges, starred=True).collect()
    assert {bytes(r["node"]) for r in got} == {b"a", b"b", b"c"} and len({bytes(r["label"]) for r in got}) == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, links):
    components.TASK_EDGES = random.Random(len(links)).choice([0, 3, 1 << 20])
    name = lambda i: hashlib.md5(b"%d" % i).hexdigest()
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in links], "a string, b string")
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    want = roots(13, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == {name(i) for i in nodes}
    assert all((got[name(i)] == got[name(j)]) == (want[i] == want[j]) for i in nodes for j in nodes)


# ---- tokens and packing

def test_token_counts(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["a  b", " lead", "trail ", "tab\t x", "a \n b", "it's 12,5% OK!!!", "x<|endoftext|> y", " nb sp", "né, été.",
           "²x, ³.", "ab 　 cd", "  ", "\n\n a"]
    rows = tokens.count_tokens(frame(spark, texts + odd), path).collect()
    library = Tokenizer.from_file(path)
    for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), texts + odd):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((t or "").encode()), n > 512), t
    assert tokens.count_tokens(frame(spark, []), path).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t abcÉ'.,!<|>1²s", max_size=30))
def test_units_keep_tokens(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, lengths = tokens.tokenizer(path), tokens.Lengths(path, ["", b""])
    head, *rest = tokens.units(text)
    count = len(library.encode(head, add_special_tokens=False).ids) + sum(lengths[u] for u in rest)
    assert count == len(library.encode(text, add_special_tokens=False).ids)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = tokens.tokenizer(path).encode(text, add_special_tokens=False).ids
    assert tokens.text_ids(path, text) == struct.pack(f"<{len(ids)}I", *ids)


def test_packing(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    rows = packing.pack(frame(spark, texts), path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in enumerate(ids):
        pieces = sorted(by_doc[i])
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(n == 4096 for _, _, n in pieces[:-1])
        assert sum(n for _, _, n in pieces) == len(own)
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by_sequence) == math.ceil(sum(map(len, ids)) / 4096)
    assert packing.pack(frame(spark, []), path).collect() == []


def best(counts, capacity):
    """Fewest bins, by trying every filling of the bin that holds the longest piece."""
    items = tuple(sorted((k for k, v in counts.items() for _ in range(v)), reverse=True))
    memo = {}

    def solve(left):
        if not left:
            return 0
        if left not in memo:
            found, rest = set(), left[1:]

            def fill(i, room, kept):
                if i == len(rest):
                    found.add(kept)
                    return
                fill(i + 1, room, kept + (rest[i],))
                if rest[i] <= room:
                    fill(i + 1, room - rest[i], kept)

            fill(0, capacity - left[0], ())
            memo[left] = 1 + min(solve(k) for k in found)
        return memo[left]

    return solve(items)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_reduction_loses_no_bin(lengths):
    counts = Counter(lengths)
    left = packing.Lengths(dict(counts))
    fixed = packing.reduce_dominated(left, 20)
    assert sum(b.count for b in fixed) + best(left.count, 20) == best(counts, 20)
    packed = fixed + packing.best_fit(left, 20)
    held = Counter()
    for b in packed:
        assert sum(n * k for n, k in b.items) + b.room == 20 and b.room >= 0
        for n, k in b.items:
            held[n] += k * b.count
    assert held == counts


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        room = min(fitting) if fitting else capacity
        if fitting:
            rooms.remove(room)
        rooms.append(room - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_by_counts(lengths):
    packed = packing.best_fit(packing.Lengths(dict(Counter(lengths))), 30)
    assert sorted(b.room for b in packed for _ in range(b.count)) == plain_best_fit(lengths, 30)


# ---- chat

TEXTS = ["", "hi", "<|im_end|>\n", "<\\|im_start|>", "a<|im_sep|>b\\", "</s>[INST] ok [/INST]", "<|im_end|>", "<\\\\|im_end|>\n<|"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="<|im_sep\\>\n", max_size=12)),
                          st.one_of(st.sampled_from(TEXTS), st.text(alphabet="<|im_endstar\\>\n", max_size=30))), max_size=5))
def test_template_reads_back(turns):
    template = chat.Template()
    assert template.parse("".join(s for r, t in turns for _, s, _ in template.segments(r, t))) == turns


def test_other_templates():
    inst = chat.Template(open="[INST]", middle="[SAYS]", close="</s>")
    assert inst.parse("".join(s for _, s, _ in inst.segments("user", "</s>[INST] ok [/INST]"))) == [("user", "</s>[INST] ok [/INST]")]
    for wrong in ({"open": "<"}, {"open": "\\x"}, {"open": "ab", "close": "ba"}, {"open": "abc", "middle": "b c", "close": "xabcx"}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def test_chat_digests(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<|im_end|>\n"), (2, 1, "assistant", "a"), (2, 0, "user", None), (2, 2, "user", "z"),
            (3, 0, "assistant", "x"), (None, 0, "user", "n"), (None, 1, None, "r"), (4, 0, "user", "s"), (4, 0, "user", "s"), (4, None, "tool", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nq\nassistant\n<|im_end|>\n\n") and got[1]["loss_sha256"] == sha("<|im_end|>\n")
    assert got[1]["valid"] and not got[2]["valid"] and not got[3]["valid"] and not got[4]["valid"]
    assert got[2]["turns_sha256"] == sha("user\n\nassistant\na\nuser\nz\n") and got[2]["loss_chars"] == 1
    assert got[None]["n_turns"] == 2 and got[None]["turns_sha256"] == sha("user\nn\n\nr\n")
    assert got[4]["turns_sha256"] == sha("tool\nt\nuser\ns\nuser\ns\n")
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


def test_long_conversations_are_streamed(spark):
    df = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("text"))
    row = chat.read_back(chat.format_turns(df)).first()
    assert row["n_turns"] == 30_000 and row["valid"] and row["loss_sha256"] == hashlib.sha256(b"t" * 15_000).hexdigest()


# ---- vectors

@pytest.mark.parametrize("cell,block", [(4096, 2048), (8, 5)])
def test_vectors(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    points = [(centres[i % 12] + rng.normal(size=16) * s).tolist() for i, s in enumerate(rng.choice([0.01, 0.06, 0.12, 1.0], 120))]
    labels = [i % 3 for i in range(120)]
    odd = [(None, 1), ([0.0] * 16, 1), ([1.0] * 15 + [None], 1), ([float("nan")] * 16, 1), ([float("inf")] + [1.0] * 15, 1),
           (points[0], None), ([], 1), ([1e30] * 16, 2), ([3e30] * 16, 2), ([1e-40] * 16, 2)]
    rows = [*zip(points, labels), (points[0], 0), (points[0], 0), *odd]
    df = spark.createDataFrame([(i, p, lab, "x") for i, (p, lab) in enumerate(rows)], "vec_id long, embedding array<double>, label int, weight string")
    got = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(df).collect()}
    links = []
    fine = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows[:i]):
            if x is not None and x == y and fine(a) and fine(b):
                u, v = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                    links.append((i, j))
    n, want = Counter(x for p in links for x in p), roots(len(rows), links)
    for i in range(len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], want[i], want[i] == i)
    assert vectors.near_duplicate_vectors(df.limit(0)).collect() == []


# ---- exact copies

def test_exact_groups(spark, texts):
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[(t or "").translate(LOWER)].append(i)
    for widths in ((8, 16), (1, 2, 16)):  # one byte collides and is widened
        got = {r["doc_id"]: r for r in exact.exact_groups(frame(spark, texts), widths).collect()}
        for text, ids in want.items():
            for i in ids:
                assert got[i].asDict() == {"doc_id": i, "keep_id": max(ids), "group_size": len(ids), "kept": i == max(ids),
                                           "text_sha256": hashlib.sha256(text.encode()).hexdigest()}
    with pytest.raises(ValueError):
        exact.exact_groups(frame(spark, ["a" * i for i in range(600)]), (1,))


def test_chunks_depend_on_the_text_alone():
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, 60_000).astype(np.uint8).tobytes().decode()
    alone = [c for run in exact._chunked(pa.array([long])) for _, c in run][0]
    after = [c for run in exact._chunked(pa.array(["some text before", None, long, "Z" * 40_000])) for _, c in run]
    assert after[2] == alone and b"".join(alone).decode() == long and max(map(len, alone)) <= exact.MOST
    assert after[1] == [] and b"".join(after[3]) == b"z" * 40_000
    moved = [c for run in exact._chunked(pa.array(["new start " + long])) for _, c in run][0]
    assert len(set(moved) & set(alone)) > len(alone) / 2


def test_distinct_texts(spark):
    df = frame(spark, ["A", "a", None, "", "b", "b", "c"], [1, 2, 3, 4, 5, 5, None])
    kept = exact.distinct_texts(df)
    assert Counter(r["doc_id"] for r in kept.collect()) == {2: 1, 4: 1, 5: 1, None: 1} and kept.columns == df.columns
    assert exact.distinct_texts(frame(spark, [])).collect() == []


# ---- pages

PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1><a href=/>home</a></header>
<div id="sidebar"><p>side text is here and long enough to matter</p></div><div class="cookie-notice">We use cookies here.</div>
<div class="content"><h2>Head &amp; all</h2><p>First paragraph of the text with <a href=x>a link</a> and more words
in it.</p><p>Second paragraph, this one is also rather long.</p><p>Short.</p></div>
<div class="comments"><div class="comment"><p>I think this is a great long comment about it all</p></div></div>
<form><p>Subscribe now</p></form><footer>foot</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == ("Head & all\nFirst paragraph of the text with a link and more words in it.\n"
                                    "Second paragraph, this one is also rather long.\nShort.")
    assert html.main_text('<div class="ad">Buy<article><header><h1>T</h1><p>by x</p></header><p>a<p>b<aside>c</aside></article>') == "T\na\nb"
    assert html.main_text("") == "" and html.main_text("<script>x</script>") == "" and html.main_text("plain &lt; text") == "plain < text"
    assert html.main_text("<![if x]>hello <![endif]> <p>world").split("\n")[-1] == "world"
    assert html.main_text("<article>" + "<p>w</p>" * 5000 + "</article>").count("w") == 5000


LONG = "A long sentence of the main text that goes on and on, as sentences of articles do, until it ends. " * 3


def test_articles_are_one_signal_among_containers():
    cards = "".join(f"<article><h3>Card {i}</h3><p>Read it</p></article>" for i in range(3))
    got = html.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p><p>Short end.</p></div><div>{cards}</div></body>")
    assert got.split("\n") == [LONG.strip(), LONG.strip(), "Short end."]
    got = html.main_text(f"<body><article><p>{LONG}</p><p>{LONG}</p></article><article><p>A short one.</p><p>Two.</p></article></body>")
    assert got.split("\n") == [LONG.strip(), LONG.strip(), "A short one.", "Two."]
    got = html.main_text(f"<body><div><h1>Title</h1><p>Lead</p></div><article><p>{LONG}</p><p>{LONG}</p></article></body>")
    assert got.split("\n") == ["Title", "Lead", LONG.strip(), LONG.strip()]


def test_region_holds_all_content_lines():
    rest = "".join(f"<p>{LONG} {i}</p>" for i in range(40))
    got = html.main_text(f"<div><div><p>{LONG}</p></div><div class=body>{rest}</div></div>").split("\n")
    assert len(got) == 41 and got[0] == LONG.strip()
    links = "".join(f"<li><a href=x>Reference number {i}</a></li>" for i in range(3))
    got = html.main_text(f"<article><p>{LONG}</p><p><a href=x>A linked paragraph.</a></p><p>{LONG}</p><ul>{links}</ul></article>").split("\n")
    assert got[1] == "A linked paragraph." and got[3:] == [f"Reference number {i}" for i in range(3)]
    got = html.main_text(f"<body><div><a href=/>Home</a></div><p>{LONG}</p><p><a href=x>Linked.</a></p><p>{LONG}</p><div><a href=/>Top</a></div></body>")
    assert got.split("\n") == [LONG.strip(), "Linked.", LONG.strip()]


def test_names_weigh_and_do_not_drop():
    for attrs in ('section id="discussion"', 'div class="related-work"', 'p class="share-price"', 'div class="search-result"'):
        tag = attrs.split()[0]
        got = html.main_text(f"<article><p>{LONG}</p><{attrs}>{LONG}</{tag}><p>{LONG}</p></article>").split("\n")
        assert got == [LONG.strip()] * 3, attrs
    assert html.main_text(f'<article class="long-form"><p>{LONG}</p><p>{LONG}</p></article>').split("\n") == [LONG.strip()] * 2
    assert html.main_text(f'<div class="form"><p>{LONG}</p><p>End.</p></div>').split("\n") == [LONG.strip(), "End."]
    got = html.main_text(f'<article><p>{LONG}</p><p class="share">Share this</p><div class="ad left">Buy it now</div><p>{LONG}</p></article>')
    assert got.split("\n") == [LONG.strip()] * 2
    got = html.main_text(f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold. {LONG}</p></article>")
    assert got == f"Let x=1 hold. {LONG}".strip()


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>é a\n b", "x"), (1, None, None, "x"), (None, "u", "", None)],
                               "page_id long, url string, html string, text string")
    assert Counter(tuple(r) for r in html.extract(df).collect()) == {(1, "u", "é a b", 5): 1, (1, None, "", 0): 1, (None, "u", "", 0): 1}
    assert html.extract(df.limit(0)).collect() == []


# ---- toxicity

@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = babble(rng, rng.randint(20, 60)).split()
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(["worthless", "numskull", "vexqua" + rng.choice("abcde")], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append(" ".join(words))
        labels.append((i, int(toxic), 1))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_restoring():
    rng = random.Random(1)
    grams = " ".join(["worthless", "numskull", "idiot", "person"] * 50 + babble(rng, 300).split())
    counts = np.ones((deobfuscation.SIZE,) * 3) * 0.01
    c = np.concatenate([[0, 0], deobfuscation._codes(grams), [0, 0]])
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    restorer = deobfuscation.Restorer(np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32))
    for seen, want in {"w0rthless": "worthless", "1d10t": "idiot", "NUM5KULL!!": "numskull", "i.d-i_o*t": "idiot", "idiiiiot": "idiot",
                       "clean": "clean", "2024": "2024", "(idiot)": "idiot", "": "", "***": ""}.items():
        assert restorer.unit(seen) == want, seen
    assert deobfuscation.spaced_words("the i d i o t here") == ["idiot"] and deobfuscation.spaced_words("a b is") == []
    assert len(restorer.unit("1a" * 5000)) >= 5000


def test_runs_of_short_units():
    grams = " ".join(["worthless", "numskull", "idiot", "person", "moron", "hate", "you", "are", "the", "a", "i"] * 50)
    counts = np.ones((deobfuscation.SIZE,) * 3) * 0.01
    c = np.concatenate([[0, 0], deobfuscation._codes(grams.replace(" ", "  ")), [0, 0]])
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    restorer = deobfuscation.Restorer(np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32))
    for text, want in {"you are a i d i o t": {"idiot"}, "i d i o t m o r o n": {"idiot", "moron"}, "I h a t e": {"hate"},
                       "an i  d  i  o  t here": {"idiot"}, "id iot": {"idiot"}, "a 1 d 1 0 t": {"idiot"}}.items():
        assert want <= set(deobfuscation.restored_words(text, restorer.unit, deobfuscation.Runs(restorer))), text
    assert restorer.unit("iddiot") == "idiot" and restorer.unit("|+@+$") != "|+@+$"
    assert restorer.unit("2024") == "2024" and restorer.unit("$100") == "$100"
    n = len(deobfuscation.restored_words("i d i o t " * 2000, restorer.unit, deobfuscation.Runs(restorer)))
    assert n > 10_000


@pytest.mark.parametrize("seed", range(4))
def test_words_left_unread_have_no_feature(seed):
    """A scorer reads few units, and what it leaves out holds no feature of the lexicon; a fit reads all words."""
    rng = random.Random(seed)
    plain = babble(rng, 400).split()
    counts = np.ones((deobfuscation.SIZE,) * 3) * 0.01
    c = np.concatenate([[0, 0], deobfuscation._codes(" ".join(["worthless", "idiot", "of", "you"] * 50 + plain)), [0, 0]])
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    letters = np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32)
    signs = ["idiotabc", "IDIOTABC", "10!@*.,-'$", "Σİςß²½ⅧÉ语\u0301\u200b", ".,!"]

    def disguised(word: str) -> str:
        word = "".join(rng.choice([x, x, x, x * 2, x * 3, rng.choice(rng.choice(signs))]) for x in word)
        return rng.choice([" ", "  ", ".", "\t"]).join(word) if rng.random() < 0.3 else word + rng.choice(["", "", ",", "...", "!!!", ".,"])

    texts = [" ".join(disguised(w) if rng.random() < 0.4 else w for w in rng.choices(["idiot", "worthless", "a", "of", *plain], k=12))
             for _ in range(150)] + ["a b Σ", "I İ a t", ",", ""]
    restorer = deobfuscation.Restorer(letters)
    every = [set(deobfuscation.restored_words(t, restorer.unit, deobfuscation.Runs(restorer))) for t in texts]
    known = toxicity._Restored(letters)
    assert [known.different(t) for t in texts] == every
    assert all(toxicity.all_features(ws) == {f for w in ws for f in toxicity.features(w)} for ws in every)
    held = sorted({f for ws in every for f in toxicity.all_features(ws)})
    for n in (5, 300):
        lexicon = {f: rng.random() for f in [*rng.sample(held, n), "idiot$", "a$"]}
        strongest = lambda w: max((f for f in toxicity.features(w) if f in lexicon), key=lexicon.get, default="")
        hits = toxicity._Hits(toxicity.Model(letters, lexicon, 0.1))
        want = [{strongest(w) for w in deobfuscation.restored_words(t, restorer.unit, deobfuscation.Runs(restorer))} - {""} for t in texts]
        assert [hits.different(t) - {""} for t in texts] == want
    calls, read = [], toxicity._Hits(toxicity.Model(letters, {"idiot$": 0.9}, 0.1))
    read.restorer.read = lambda word: calls.append(word) or word
    read.different("You worthless person, Plain WORDS of this text. An idiot, it is said to be so")
    assert calls == ["idiot"]


def test_toxicity(spark, labelled):
    texts, labels = labelled
    docs = frame(spark, texts)
    model = toxicity.fit(docs, labels)
    assert model.lexicon["worthless$"] >= 0.5 and max(v for k, v in model.lexicon.items() if k.startswith("^vexq")) >= 0.5
    more = [*texts, None, "", "you w0rthless n u m s k u l l", "vexquazz"]
    rows = {r["doc_id"]: r for r in toxicity.score(frame(spark, more), model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    held = [i for i in range(600) if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    assert rows[600]["score"] == rows[601]["score"] < 0.5 and rows[602]["predicted"] and rows[603]["predicted"]
    kept = toxicity.clean(frame(spark, more), model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if not r["predicted"]} and kept.columns == docs.columns
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a", None], [1, None])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score(docs, model).collect()] == [0, 0]


# ---- mixing

def test_water_fill(spark):
    sources = spark.createDataFrame([("a", 10, 1), ("b", 1000, 2), ("c", 0, 3), (None, 500, 1)], "source string, source_size long, weight int")
    got = {r["source"]: r["target"] for r in mixing.water_fill(sources, 3).collect()}
    level = (1510 - 30) / 3
    assert got == {"a": 30.0, "c": 0.0, "b": 2 * level, None: level}
    assert [r["target"] for r in mixing.water_fill(sources.limit(0), 3).collect()] == []


def test_mix(spark):
    rng = random.Random(4)
    sources = [rng.choice(["a", "b", "c", "c", "c", None]) for _ in range(900)]
    texts = [rng.choice([None, "", "w"]) if i % 9 == 0 else "w " * rng.randint(1, 80) for i in range(900)]
    ids = [i if i % 50 else 7 for i in range(900)]
    docs = frame(spark, texts, ids, sources)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 900 and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    by = defaultdict(list)
    for r in rows:
        assert r["_size"] == len((r["text"] or "").split()) and 0 <= r["_repeats"] <= 3
        by[r["source"]].append(r)
    for own in by.values():
        assert sum(r["_size"] for r in own) == own[0]["_source_size"] and own[0]["_target"] <= 3 * own[0]["_source_size"]
        assert abs(sum(r["_size"] * r["_repeats"] for r in own) - own[0]["_target"]) <= 10 * 80  # rows of one id go together
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["_repeats"]
    assert Counter(r["doc_id"] for r in mixing.repeated(docs).collect()) == +want
    assert mixing.mix(docs.limit(0)).collect() == []
