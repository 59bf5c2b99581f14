"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import LOWER, bytes_of, keeping_nothing, random64, slices, whole_row

#: Chunks have 512 to 16,384 bytes, 2,048 more than the least on average; only a text's last one may be shorter.
LEAST, MOST, BITS = 512, 16384, 11
WINDOW = 32
_GEAR = (random64(256, 7) >> np.uint64(32)).astype(np.uint32)
_STEP = 4 << 20


def _candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the last 32 bytes hash to a value with 11 leading zeros."""
    found = []
    for at in range(0, len(data), _STEP):
        start = max(0, at - WINDOW + 1)
        h = _GEAR[data[start:at + _STEP]]
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k] << np.uint32(k)  # the sum over twice as many bytes, older ones shifted further
        ends = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + start + 1
        found.append(ends[ends > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _cut(start: int, end: int, candidates: list[int]) -> list[int]:
    """The ends of one text's chunks, given the candidates inside it. They depend on its bytes alone."""
    ends, last = [], start
    for c in [*candidates, end]:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST and c != end:
            ends.append(c)
            last = c
    if end > last:
        ends.append(end)
    return ends


def _chunked(column: pa.Array) -> Iterator[list[tuple[bytes, list[bytes]]]]:
    """For runs of rows, each text, A-Z lower-cased, as bytes and as its chunks."""
    raw, offsets = bytes_of(column)
    for a, b in slices(offsets, _STEP):
        data = LOWER[raw[offsets[a]:offsets[b]]]
        own = offsets[a:b + 1] - offsets[a]
        ends = _candidates(data)
        at, whole, run = np.searchsorted(ends, own, "right"), data.tobytes(), []
        for i in range(b - a):
            s, e = int(own[i]), int(own[i + 1])
            cuts = _cut(s, e, ends[at[i]:at[i + 1]].tolist())
            run.append((whole[s:e], [whole[x:y] for x, y in zip([s, *cuts], cuts)]))
        yield run


def _chunk_id(chunk: bytes, width: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def recipes(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``text_sha256`` and ``recipe``: the identifiers of the text's chunks, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, recipe = [], []
            for texts in _chunked(batch.column(1)):
                sha += [hashlib.sha256(text).hexdigest() for text, _ in texts]
                recipe += [b"".join(_chunk_id(c, width) for c in chunks) for _, chunks in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())],
                                             ["doc_id", "text_sha256", "recipe"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        keeping_nothing(run), "doc_id long, text_sha256 string, recipe binary")


def collisions(docs: DataFrame, width: int) -> DataFrame:
    """Identifiers that stand for more than one chunk. Each distinct chunk is moved once per task that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _chunked(batch.column(0)):  # some MB at a time
                seen = {c for _, chunks in texts for c in chunks}
                yield pa.RecordBatch.from_arrays([pa.array([_chunk_id(c, width) for c in seen], pa.binary()),
                                                  pa.array(list(seen), pa.binary())], ["chunk_id", "chunk"])

    chunks = docs.select("text").mapInArrow(keeping_nothing(run), "chunk_id binary, chunk binary")
    return chunks.distinct().groupBy("chunk_id").count().filter("count > 1")


def exact_groups(docs: DataFrame, widths: tuple[int, ...] = (8, 16, 32, 64)) -> DataFrame:
    """Per row: ``doc_id``, ``keep_id`` (the largest doc_id with an equal text), ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Chunk identifiers are hashes verified against the chunks'
    bytes over all documents; if two chunks share one, all identifiers are made wider and verified again. Then only
    the ordered identifier lists are compared. Null is the empty text; rows repeated under one ``doc_id`` share its
    decision; null ids lose to any other; an empty table gives an empty table.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    for width in widths:
        if collisions(docs, width).isEmpty():
            break
    else:
        raise ValueError("chunk identifiers can't be made unique")
    # the second key makes Spark exchange both sides, so that it can split the rows of a very large group
    rows = recipes(docs, width).withColumn("_hash", F.xxhash64("recipe")).checkpoint()
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select(
        F.col("recipe").alias("_recipe"), F.xxhash64("recipe").alias("_group_hash"), "keep_id", "group_size")
    return rows.join(groups, (F.col("_hash") == F.col("_group_hash")) & (F.col("recipe") == F.col("_recipe"))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns, each once. Columns of any name pass
    through: a row travels as one struct."""
    groups = exact_groups(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("id"), F.sha2(text, 256).alias("sha"))
    kept = rows.alias("r").join(groups.alias("g"), F.col("r.id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.sha") == F.col("g.sha")), "left_semi")
    return kept.dropDuplicates(["id", "sha"]).select("row.*")
