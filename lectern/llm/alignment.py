"""Alignment of two tokenizers' tokens over whole texts, and how often each id pair is linked in the corpus.

Both tokenizers encode the whole text. Where tokens of both end and both next tokens start with a space, the text is cut;
since each side's bytes are checked against the text, such an anchor is a shared end for certain. The windows between
anchors are mostly words, so their alignments are remembered by the windows' id tuples.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import Learnt, slices, texts_of, worker_held
from .tokens import _WRITTEN, tokenizer

#: Pairs whose counts are broadcast (13 bytes each), pairs a task counts before it reports.
HEAD, COUNTED = 1 << 20, 1 << 20
#: An id pair is one number: A's id times this, plus B's (vocabularies of at most 65,536 and 32,768 entries).
B_IDS = 1 << 15
_BYTES_OF = {c: b for b, c in _WRITTEN.items()}
#: Characters whose classes no two versions of Unicode disagree on.
_SETTLED = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
_PIECES = re.compile("<0x([0-9A-F]{2})>")


class ByteLevel:
    """A byte-level BPE file. Texts of settled characters go through its vocabulary as merge ranks, which is faster; that
    is the same where merges come in the order of the ids they make, as is checked, else the file's library encodes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in _BYTES_OF for c in entry):
                self.bytes[i] = bytes(_BYTES_OF[c] for c in entry)
        self.library = tokenizer(path)
        self.ranked = None
        single = [i for i, x in enumerate(self.bytes) if len(x) == 1]
        if all(a < b for a, b in zip(made, made[1:])) and len(single) == 256 and max(single) < made[0]:
            import public_tokenizers
            import tiktoken

            ranks = {x: i for i, x in enumerate(self.bytes) if len(x) == 1} | {self.bytes[i]: i for i in made}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts without special tokens; their strings are plain text."""
        out: list = [None] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if self.ranked is not None and _SETTLED.fullmatch(text):
                out[k] = self.ranked.encode_ordinary(text)
            else:
                rest.append(k)
        if rest:
            before = self.library.encode_special_tokens
            self.library.encode_special_tokens = True
            encoded = self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)
            self.library.encode_special_tokens = before
            for k, e in zip(rest, encoded):
                out[k] = e.ids
        return out


class Pieces:
    """A sentencepiece file and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(m[1], 16)]) if (m := _PIECES.fullmatch(x)) else x.replace("▁", " ").encode() for x in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def align(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> tuple[str, int, bytes]:
    """Tokens of one window (of as many bytes on both sides) as ``a1,a2|b1;a3|b2``, the number of those groups, and one
    id pair for each two tokens that overlap, as 32-bit numbers."""
    pairs, written, groups = [], [], 1
    i = j = 0
    left, right = [], []
    x, y = a[0], b[0]
    gap = a_size[x] - b_size[y]  # how far A's token ends behind B's
    last_a, last_b = len(a) - 1, len(b) - 1
    while True:
        pairs.append(x * B_IDS + y)
        if gap < 0:
            left.append(str(x))
            i += 1
            x = a[i]
            gap += a_size[x]
        elif gap > 0:
            right.append(str(y))
            j += 1
            y = b[j]
            gap -= b_size[y]
        else:
            left.append(str(x))
            right.append(str(y))
            written.append(",".join(left) + "|" + ",".join(right))
            if i == last_a and j == last_b:
                return ";".join(written), groups, array("i", pairs).tobytes()
            groups += 1
            left, right = [], []
            i, j = i + 1, j + 1
            x, y = a[i], b[j]
            gap = a_size[x] - b_size[y]


class Aligner:
    """Both tokenizers of a worker and the alignments it has learnt."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        assert len(self.b.bytes) <= B_IDS and len(self.a.bytes) <= 1 << 16
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.marked = [np.array([x[:1] == b" " for x in t.bytes]) for t in (self.a, self.b)]
        a_size, b_size = (s.tolist() for s in self.sizes)

        def learn(key: tuple[bytes, bytes]) -> tuple[str, int, bytes]:
            return align(memoryview(key[0]).cast("i").tolist(), memoryview(key[1]).cast("i").tolist(), a_size, b_size)

        self.windows = Learnt(learn, 96 << 20)

    def _encoded(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides; none where a text is empty or either side's bytes are not a space and the text."""
        spaced = [" " + t for t in texts]
        for text, whole, a, b in zip(texts, spaced, self.a.encode(spaced), self.b.encode(texts)):
            raw = whole.encode()
            same = (text and b"".join(map(self.a.bytes.__getitem__, a)) == raw
                    and b"".join(map(self.b.bytes.__getitem__, b)) == raw)
            yield (a, b) if same else ([], [])

    def documents(self, texts: list[str]) -> list[tuple]:
        """Per text: n_a, n_b, n_groups, n_links, groups_sha256, its distinct id pairs and how often each is linked."""
        both = list(self._encoded(texts))
        if not both:
            return []
        ids = [np.fromiter(chain.from_iterable(side), np.int32, sum(map(len, side))) for side in zip(*both)]
        ends = [np.cumsum(size[own]) for size, own in zip(self.sizes, ids)]
        total = int(ends[0][-1]) if len(ends[0]) else 0
        # A window ends at a shared end before tokens with a space on both sides, or at the end of a text.
        cut = np.ones(total + 1, bool)
        for own, end, marked in zip(ids, ends, self.marked):
            here = np.zeros(total + 1, bool)
            here[end[:-1]] = marked[own[1:]]
            cut &= here
        last = [np.cumsum([len(x) for x in side]) for side in zip(*both)]
        cut[ends[0][last[0][last[0] > 0] - 1]] = True
        bounds = [np.flatnonzero(cut[end]) + 1 for end in ends]
        windows = np.searchsorted(bounds[0], last[0], "right").tolist()
        raw = [own.tobytes() for own in ids]
        at = [[0, *(4 * b).tolist()] for b in bounds]
        out, w = [], 0
        learnt = self.windows
        for (a, b), end in zip(both, windows):
            if not a:
                out.append((0, 0, 0, 0, "", b"", b""))
                continue
            found = [learnt[raw[0][i:j], raw[1][k:m]] for i, j, k, m in
                     zip(at[0][w:end], at[0][w + 1:end + 1], at[1][w:end], at[1][w + 1:end + 1])]
            w = end
            links = np.frombuffer(b"".join([x[2] for x in found]), "<i4")
            pairs, times = np.unique(links, return_counts=True)
            digest = hashlib.sha256(";".join([x[0] for x in found]).encode()).hexdigest()
            times = times.astype(np.uint8 if times.max() < 256 else np.int64)
            out.append((len(a), len(b), sum(x[1] for x in found), len(links), digest, pairs.tobytes(), times.tobytes()))
        return out


def _times(pairs: np.ndarray, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == len(pairs) else np.int64).astype(np.int64)


_COLUMNS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
            ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]


def linked_pairs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)`` its alignment: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its
    distinct id pairs with their numbers of links, packed (``pairs``, ``times``). Texts go through the tasks once, in
    their input partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_held(f"alignment {a_path} {b_path}", lambda: Aligner(a_path, b_path))
        for batch in batches:
            texts = texts_of(batch.column(1))
            size = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for a, b in slices(size, 1 << 20):
                own = zip(*aligner.documents(texts[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(
                    pa.array(c, t) for c, (_, t) in zip(own, _COLUMNS[1:]))], [n for n, _ in _COLUMNS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n`` (documents that link it) and ``best`` (no other pair of its A id has more). Tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            for a, b in slices(np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy())]), 8 << 20):
                more = np.frombuffer(b"".join(batch.column(0).slice(a, b - a).to_pylist()), "<i4")
                pairs, place = np.unique(np.concatenate([pairs, more]), return_inverse=True)
                n = np.bincount(place, np.concatenate([n, np.ones(len(more), np.int64)]), len(pairs)).astype(np.int64)
                if len(pairs) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
                    pairs, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    counts = aligned.select("pairs").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", 15)).checkpoint()
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most one row per id of A's vocabulary
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _head(counts: DataFrame) -> tuple[int, int]:
    """The least class of n (eight to an octave) so that all pairs of that class and above are at most ``HEAD``."""
    level = F.floor(F.log2("n") * 8)
    total, least = 0, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # some hundred classes
        total += row["count"]
        if total > HEAD:
            return row["level"] + 1
        least = row["level"]
    return least


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` is a byte-level BPE file (it encodes space + text), ``b_path`` a sentencepiece file (it adds the space);
    both are present on every machine. A text that is null or empty, or that either side does not give back byte for
    byte, has no tokens: zeros and an empty string. A pair's count is the number of rows that link it: repeated rows
    count each. Rows with a null doc_id are aligned like others.

    Alignments are written once. The counts of the most frequent pairs (at most ``HEAD``, 13 bytes each) are broadcast;
    pairs beyond them, each rare, are joined by pair and added up per row.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    aligned = linked_pairs(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    counts = pair_counts(aligned).checkpoint()
    frequent = F.floor(F.log2("n") * 8) >= _head(counts)
    table = counts.filter(frequent).toArrow()
    known = np.argsort(table.column("pair").to_numpy(), kind="stable")
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy()[known] for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            out = []
            for own, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                own = np.frombuffer(own, "<i4")
                times = _times(own, times)
                at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
                hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                at = at[hit]
                out.append((int(times[hit] @ best[at].astype(np.int64)), int(times[hit] @ n[at]), own[~hit], times[~hit]))
            left = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*left, *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], [
                "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rare", "rare_times"])

    looked_up = aligned.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                   "groups_sha256 string, n_best long, count_sum long, rare array<int>, rare_times array<long>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    complete = looked_up.filter(F.size("rare") == 0).select(columns)
    rest = looked_up.filter(F.size("rare") > 0)
    links = rest.select("row", F.inline(F.arrays_zip(F.col("rare").alias("pair"), F.col("rare_times").alias("times"))))
    more = (links.join(counts.filter(~frequent), "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    completed = rest.join(more, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.col("more_best")).alias("n_best"),
        (F.col("count_sum") + F.col("more_sum")).alias("count_sum"), "groups_sha256")
    return complete.unionByName(completed)
