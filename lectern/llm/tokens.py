"""Token counts and token ids of whole texts through a broadcast table and worker caches, without a token shuffle."""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import Learnt, texts_of, worker_held

#: Rows of the broadcast table of frequent units, and distinct units a task counts at once.
FREQUENT, HELD = 65_536, 200_000
_LOOSE = re.compile(r" (?!\S)")
_SPLIT = re.compile(r" (?=\S)")
#: Signs that stand behind a word without ever joining it in a pre-token.
_TAILED = re.compile(r"(.+?)([.,;:!?%*$&#|]+)")
#: Words that are one pre-token and that no normaliser changes but for their case.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level vocabularies write each byte as a character: itself where it prints, else the next free one from 256 on.
_WRITTEN = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer for a file, loaded once per worker and used on one thread per task."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def word_tokens(model, word: str) -> list:
    """Tokens of one pre-token by the library's model alone, without its normaliser and splitter (a quarter of the time)."""
    return model.tokenize(word.encode().decode("latin-1").translate(_WRITTEN))


def units(text: str) -> list[str]:
    """Cut before every space that a non-space follows. All but the first unit lost that space.

    A byte-level pre-tokenizer always starts a new pre-token there, and what comes before it doesn't depend on what
    follows, so a text's tokens are those of its first unit and of " " + each other unit.
    """
    return _SPLIT.split(text) if _LOOSE.search(text) else text.split(" ")


class Lengths(Learnt):
    """Tokens per unit: knows the broadcast table, learns what it misses."""

    def __init__(self, path: str, table: list):
        names, lengths = table
        self.table = dict(zip(names.split(" "), np.frombuffer(lengths, np.uint32).tolist())) if lengths else {}
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.signs = Learnt(lambda tail: len(self.tokenizer.encode(tail, add_special_tokens=False).ids), 4 << 20)
        super().__init__(self.count, 48 << 20)

    def count(self, unit: str) -> int:
        n = self.table.get(unit)
        if n is not None:
            return n
        m = _TAILED.fullmatch(unit)
        if m and m[1].isalpha():  # a word and the signs behind it are pre-tokens of their own
            return self[m[1]] + self.signs[m[2]]
        if _PLAIN.fullmatch(unit):
            return len(word_tokens(self.model, " " + unit))
        return len(self.tokenizer.encode(" " + unit, add_special_tokens=False).ids)


def frequent_units(docs: DataFrame) -> DataFrame:
    """At most ``FREQUENT`` rows (unit, n), the most frequent by classes of n, gathered from every text.

    Each task counts its units; beyond ``HELD`` distinct ones it lowers all counts and drops those at zero
    (Misra-Gries), and reports its ``FREQUENT`` largest. Only these summaries are shuffled. They decide what is worth
    broadcasting, never a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                seen.update(units(text)[1:])
            if len(seen) > HELD:
                least = sorted(seen.values(), reverse=True)[HELD // 2]
                seen = Counter({k: v - least for k, v in seen.items() if v > least})
        top = [(k, v) for k, v in seen.most_common(FREQUENT) if v > 1 and " " not in k and len(k) <= 100]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())],
                                         ["unit", "n"])

    ensure_checkpoint_dir(docs.sparkSession)
    found = docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).checkpoint()
    level = F.floor(F.log2("n") * 8)
    total, least = 0, 0
    for row in sorted(found.groupBy(level.alias("level")).count().collect(), reverse=True):  # some hundred levels
        total += row["count"]
        if total > FREQUENT:
            least = row["level"] + 1
            break
    return found.filter(level >= least)


def broadcast_lengths(docs: DataFrame, path: str) -> Broadcast:
    """The table as one string of names and one array of lengths (some MB at most, whatever the input)."""
    names = [r["unit"] for r in frequent_units(docs).collect()]
    encoded = tokenizer(path).encode_batch([" " + x for x in names], add_special_tokens=False)
    lengths = np.array([len(e.ids) for e in encoded], np.uint32).tobytes()
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, " ".join(names), lengths))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row; null is the empty text, of 0 tokens.

    Counts equal the library's for the whole text. Texts go through the tasks once, in their input partitions.
    ``path`` is the tokenizer file, present on every machine.
    """
    shared = broadcast_lengths(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, *table = shared.value  # what is learnt outlives a task, not the table
        lengths = worker_held(f"lengths {version}", lambda: Lengths(path, table))
        first = lengths.tokenizer
        for batch in batches:
            texts = texts_of(batch.column(1))
            n = []
            for text in texts:
                head, *rest = units(text)
                n.append(len(first.encode(head, add_special_tokens=False).ids) + sum(map(lengths.__getitem__, rest)))
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class Ids(Learnt):
    """Token ids per white-space unit as little-endian 32-bit bytes, learnt as they come."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        super().__init__(self.encode, 80 << 20)

    def encode(self, unit: str) -> bytes:
        if not unit:
            return b""
        m = _TAILED.fullmatch(unit)
        if m and m[1].isalpha():  # a word and the signs behind it are pre-tokens of their own
            return self[m[1]] + self[m[2]]
        if _PLAIN.fullmatch(unit):  # the tokenizer lower-cases too
            low = unit.lower()
            return self[low] if low != unit else array("I", [t.id for t in word_tokens(self.model, unit)]).tobytes()
        return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()


def text_ids(path: str, text: str) -> bytes:
    """Ids of a whole text as little-endian 32-bit bytes, for a tokenizer that drops white space: its units are
    the pieces between spaces and line ends."""
    ids = worker_held(f"ids {path}", lambda: Ids(path))
    return b"".join(map(ids.__getitem__, chain.from_iterable(line.split(" ") for line in text.split("\n"))))
