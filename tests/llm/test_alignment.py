"""Token alignment against a plain version over all byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, pairs string, row string, n string, best string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "p", "r", "n", "b") for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def plain():
    library = Tokenizer.from_file(A_PATH)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    character = {b: chr(b) for b in printed}
    character |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printed)}
    byte = {c: b for b, c in character.items()}

    def run(texts):
        docs = []
        for text in texts:
            text = text or ""
            a = library.encode(" " + text, add_special_tokens=False).ids if text else []
            b = pieces.encode(text) if text else []
            a_bytes = [bytes(byte[c] for c in library.id_to_token(x)) for x in a]
            b_bytes = []
            for x in b:
                name = pieces.id_to_piece(x)
                b_bytes.append(bytes([int(name[3:5], 16)]) if name[:3] == "<0x" and len(name) == 6 else name.replace("▁", " ").encode())
            raw = (" " + text).encode()
            if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
                docs.append(None)
                continue
            spans = [[], []]
            for side, own in zip(spans, (a_bytes, b_bytes)):
                at = 0
                for x in own:
                    side.append((at, at + len(x)))
                    at += len(x)
            links, j = [], 0
            for (s, e), x in zip(spans[0], a):
                while spans[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(b) and spans[1][k][0] < e:
                    links.append((x, b[k]))
                    k += 1
            ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
            parts = []
            for side, own in zip(spans, (a, b)):
                group = defaultdict(list)
                g = 0
                for (_, e), x in zip(side, own):
                    while e > ends[g]:
                        g += 1
                    group[g].append(str(x))
                parts.append([",".join(group[g]) for g in range(len(ends))])
            docs.append((len(a), len(b), links, ";".join(f"{x}|{y}" for x, y in zip(*parts)), len(ends)))
        counts = Counter(p for d in docs if d for p in set(d[2]))
        most = defaultdict(int)
        for (x, _), n in counts.items():
            most[x] = max(most[x], n)
        return [(0, 0, 0, 0, 0, 0, "") if d is None else (
            d[0], d[1], d[4], len(d[2]), sum(counts[p] == most[p[0]] for p in d[2]), sum(counts[p] for p in d[2]),
            hashlib.sha256(d[3].encode()).hexdigest()) for d in docs]

    return run


TEXTS = ["The cat sat on the mat.", "The cat, the cat; THE CAT", "  two  spaces ", "tab\tline\n\nend", "naïve café über straße ñandú",
         "日本語 テキスト と 한국어", "emoji \U0001F600\U0001F469‍\U0001F680 end", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", " x", None, "",
         " ", "12345 67,89 e-mail@x.org", "unbelievablyhyphenated-wordswithoutspaces", "ﬁ ligature Å", "a\x00b", "cat", "cat", "don't we'll I'M"]


@pytest.mark.parametrize("head", [1 << 20, 3])
def test_alignment(spark, plain, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    monkeypatch.setattr(alignment, "COUNTED", 50)
    texts = TEXTS + ["y" * 200_000, "word " * 30_000]
    ids = [*range(len(texts) - 2), 7, None]
    rows = alignment.align_tokens(frame(spark, texts, ids), A_PATH, B_PATH).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter((i, *x) for i, x in zip(ids, plain(texts)))
    assert alignment.align_tokens(frame(spark, []), A_PATH, B_PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abe '.,-  \n\tTé1"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_documents_equal_plain(plain, texts):
    aligner = alignment.worker_held("test", lambda: alignment.Aligner(A_PATH, B_PATH))
    got = [(d[0], d[1], d[2], d[3], d[4]) for d in aligner.documents(texts)]
    assert got == [(x[0], x[1], x[2], x[3], x[6]) for x in plain(texts)]


def test_ranks_equal_the_library():
    a = alignment.ByteLevel(A_PATH)
    assert a.ranked is not None
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh  '.,;stTHE\n\t0123éßÑ¿") for _ in range(rng.randint(0, 120))) for _ in range(2_000)]
    library = Tokenizer.from_file(A_PATH)
    assert a.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
