"""Toxicity of whole texts: restored words against a lexicon learnt from labelled rows."""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Learnt, mix64, texts_of, worker_held
from .deobfuscation import Known, Restorer, language_model
from .shingles import shingle_sets

#: Labelled rows that the lexicon is fitted on, at most (a documented bound; all other counts are over all rows).
FIT_ROWS = 30_000
#: Different features that a task counts at once.
SEEN = 100_000
#: Cautious precision: this many clean documents are added to those that hold a feature.
DOUBT = 6
PREFIXES = (3, 4, 5, 6, 7, 8)
#: What is left of a toxic document's weight with each feature that explains it; the least weight of a feature.
FADE, LEAST = 0.7, 0.4


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; 0 is held out. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5


def features(word: str) -> list[str]:
    """A word and its beginnings; inflected and invented relatives of a word share its beginning."""
    return [f"{word}$", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]


def all_features(words: set[str]) -> set[str]:
    """The different :func:`features` of some words."""
    found = {w + "$" for w in words}
    for k in PREFIXES:
        found.update(["^" + start for start in {w[:k] for w in words if len(w) >= k}])
    return found


@dataclass
class Model:
    letters: np.ndarray
    lexicon: dict[str, float]
    base: float


class _Restored(Known):
    """Restored words by unit."""

    def __init__(self, letters: np.ndarray):
        restorer = Restorer(letters)
        super().__init__(restorer, restorer.unit)


class _Hits(Known):
    """The strongest lexicon feature of each unit, restored first."""

    def __init__(self, model: Model):
        self.restorer, self.lexicon = Restorer(model.letters), model.lexicon
        words = [f[:-1] for f in model.lexicon if f.endswith("$")] + [f[1:] for f in model.lexicon if f.startswith("^")]
        super().__init__(self.restorer, self.strongest, {w[:self.START] for w in words})

    def strongest(self, unit: str) -> str:
        word, known = self.restorer.unit(unit), self.lexicon
        found = [f for f in features(word) if f in known]
        return max(found, key=known.__getitem__) if found else ""


def _training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Texts with a label outside the held-out fold, at most ``rows`` by hash order, each different text once."""
    known = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(
        F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("doc_id")).limit(rows)
    # at most `rows` narrow rows
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        "text", F.col("_toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The character model of all texts, and a lexicon by sequential covering of the labelled sample.

    A feature's weight is toxic / (toxic + clean + DOUBT), where a toxic document counts less the more features already
    explain it and the more near copies it has; the best is taken until none reaches ``LEAST``. So what merely comes
    with an insult, as in a text copied many times, stays out.
    """
    spark = docs.sparkSession
    letters = language_model(docs)
    shared, version = spark.sparkContext.broadcast(letters), uuid.uuid4().hex
    sample = _training(docs, labels, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored, seen = worker_held(f"restored {version}", lambda: _Restored(shared.value)), (Counter(), Counter())

        def counts() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                                               pa.array([seen[0][k] for k in keys], pa.int64())], ["feature", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                seen[toxic].update(all_features(restored.different(text)) | {""})  # the empty one counts the documents themselves
            if sum(map(len, seen)) > SEEN:
                yield counts()
                for n in seen:
                    n.clear()
        yield counts()

    counts = sample.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    useful = counts.filter(F.expr(f"feature = '' OR toxic >= clean + {DOUBT}")).toArrow().to_pylist()
    totals = next((r for r in useful if not r["feature"]), {"toxic": 0, "clean": 0})
    clean = {r["feature"]: r["clean"] for r in useful if r["feature"]}
    wanted = spark.sparkContext.broadcast(set(clean))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = worker_held(f"restored {version}", lambda: _Restored(shared.value))
        for batch in batches:
            found = [sorted(all_features(restored.different(t)) & wanted.value) for t in texts_of(batch.column(0))]
            least = [_least_shingles(s) for sets in shingle_sets(batch.column(0)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())),
                                              pa.array(least, pa.list_(pa.int64()))], ["found", "least"])

    held = sample.filter("toxic = 1").mapInArrow(present, "found array<string>, least array<long>").toArrow()
    texts, least = [set(x) for x in held.column("found").to_pylist()], held.column("least").to_pylist()
    alike = Counter(x for keys in least for x in set(keys))
    lexicon = cover(texts, clean, [1 / max((alike[x] for x in keys), default=1) for keys in least])
    unexplained = sum(not (t & lexicon.keys()) for t in texts)
    return Model(letters, lexicon, min(0.4, (unexplained + 1) / (unexplained + totals["clean"] + 2)))


def _least_shingles(shingles: np.ndarray) -> list[int]:
    """Four min-hashes of a text's shingles: near copies share one, other texts don't."""
    with np.errstate(over="ignore"):
        return [int(mix64(shingles + np.uint64(k)).min().view(np.int64)) for k in range(1, 5)] if len(shingles) else []


def cover(texts: list[set[str]], clean: dict[str, int], weights: list[float]) -> dict[str, float]:
    """Weighted covering: ``texts`` are the features of toxic documents, ``clean`` their counts in clean ones."""
    holders, left, lexicon, weights = defaultdict(list), Counter(), {}, list(weights)
    for i, t in enumerate(texts):
        for f in t:
            holders[f].append(i)
            left[f] += weights[i]
    weight = lambda f: left[f] / (left[f] + clean[f] + DOUBT)
    left = Counter({f: n for f, n in left.items() if weight(f) >= LEAST})
    texts = [t & left.keys() for t in texts]
    while left:
        best = max(left.keys() - lexicon.keys(), default=None, key=lambda f: (round(weight(f), 9), len(f), f))
        if best is None or weight(best) < LEAST:
            break
        lexicon[best] = weight(best)
        word = best.strip("^$")
        for i in holders[best]:
            same = {f for f in texts[i] if word.startswith(f.strip("^$"))}  # beginnings of the word tell nothing new
            texts[i] = texts[i] - same
            left.subtract({f: weights[i] for f in same})
            left.subtract({f: weights[i] * (1 - FADE) for f in texts[i]})
            weights[i] *= FADE
    return lexicon


def _score(text: str, hits: _Hits, model: Model) -> float:
    found = hits.different(text)
    found.discard("")
    return 1 - math.prod(1 - model.lexicon[f] for f in found) if found else model.base


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row, from its whole restored text.

    The score is a noisy-or over the weights of the different lexicon features among the words, or the share of toxic
    documents among those that hold none. Null texts are empty and get that share; only the text is an input.
    """
    shared, version = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        hits = worker_held(f"hits {version}", lambda: _Hits(model))
        for batch in batches:
            scores = np.array([_score(t, hits, model) for t in texts_of(batch.column(2))], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id")) == 0).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def restore(docs: DataFrame, letters: np.ndarray) -> DataFrame:
    """``doc_id`` and the text's words as restored, in order, one space between them."""
    shared, version = docs.sparkSession.sparkContext.broadcast(letters), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = worker_held(f"restored {version}", lambda: _Restored(shared.value))
        for batch in batches:
            words = [" ".join(map(restored.__getitem__, t.split())) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], ["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, restored string")


def clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``most``."""
    shared, version = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        hits = worker_held(f"hits {version}", lambda: _Hits(model))
        for batch in batches:
            yield batch.filter(pa.array([_score(t, hits, model) < most for t in texts_of(batch.column(at))], pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold dots or equal each other's case
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
