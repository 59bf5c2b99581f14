"""Fingerprints of whole texts under which edit distance turns into Hamming distance, and near-copies found by them.

Randomised edit embedding: a walk reads a text from its first character; at step i it writes the character it stands on
and moves to the next one if the random bit r(i, character) says so. The bits are shared by all texts, so two walks that
meet after an edit go on together with constant probability, and few edits change few steps. A character is therefore a
jump of the step counter, one table look-up, and the written string is known from the steps at which its characters end.
A fingerprint samples that string at the steps of least priority under a fixed hash: the sample of a longer walk, cut to
the steps of a shorter one, is the start of the shorter one's sample, so texts of any two lengths can be compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import groups, mix64, random64, slices, texts_of
from .components import components

#: Independent walks, sampled steps of each, steps after which the shared bits repeat.
WALKS, SAMPLES, PERIOD = 2, 128, 1 << 12
#: Bands of a walk, sampled characters that one band reads at least and at most.
BANDS, FEWEST, ROWS = 12, 3, 5
#: Texts that no longer walk side by side, characters that a task walks at a time.
ALONE, CHARS = 60, 1 << 22
#: Rows of one range of documents, rows of one bucket that a task scans before the bucket is dealt out.
RANGE_ROWS, BLOCK_ROWS = 4_000, 20_000
SAME = 0.75


def _jumps(seed: int) -> np.ndarray:
    """For each of 256 character classes: steps that a walk stays on such a character, by the step it arrives at."""
    moves = (random64(PERIOD * 4, seed).view(np.uint8)[:, None] >> np.arange(8, dtype=np.uint8) & 1).reshape(256, PERIOD)
    stay = np.zeros((256, PERIOD), np.uint8)
    left = np.zeros(256, np.int64)
    for i in [*range(PERIOD - 1, -1, -1), *range(PERIOD - 1, -1, -1)]:  # twice round, since the bits repeat
        left = np.where(moves[:, i] == 1, 1, left + 1)
        stay[:, i] = left
    return stay


_TABLES = [_jumps(71 + w) for w in range(WALKS)]
_ROWS = [[row.tobytes() for row in table] for table in _TABLES]
_ranked: dict[tuple[int, int], np.ndarray] = {}


def _priority(steps: np.ndarray, walk: int) -> np.ndarray:
    return mix64(steps.astype(np.uint64) + np.uint64((walk + 1) << 48))


def sampled(length: int, walk: int) -> np.ndarray:
    """The ``SAMPLES`` steps below ``length`` of least priority (all, if there are fewer), least first."""
    key = (walk, max(length, 1).bit_length())
    if key not in _ranked:
        all_steps = np.arange(1 << key[1])
        rank = _priority(all_steps, walk)
        if len(rank) > 16 * SAMPLES:
            all_steps = np.argpartition(rank, 16 * SAMPLES)[:16 * SAMPLES]
        _ranked[key] = all_steps[np.argsort(rank[all_steps])]
    out = _ranked[key]
    out = out[out < length][:SAMPLES]
    if len(out) < min(length, SAMPLES):  # as good as never: too few of the listed steps lie below the length
        every = np.arange(length)
        out = every[np.argsort(_priority(every, walk), kind="stable")][:SAMPLES]
    return out


def classes(text: str) -> np.ndarray:
    """Characters as classes 0..255: code points folded to a byte, plain ASCII as it is."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((points ^ (points >> np.uint32(8)) * np.uint32(37)) & np.uint32(255)).astype(np.uint8)


def steps(codes: list[np.ndarray], walk: int, starts: list[int] | None = None) -> list[np.ndarray]:
    """Per text, the step at which the walk leaves each character, if it arrives at the first one at the text's start.

    Texts walk side by side, a character each at a time; the few longest go on one by one.
    """
    table, mask = _TABLES[walk], PERIOD - 1
    lengths = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    flat = np.concatenate([codes[k] for k in order]) if len(codes) else np.zeros(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(ordered)])
    first = np.zeros(len(codes), np.int64) if starts is None else np.array(starts, np.int64)[order]
    at, i = offsets[:-1].copy(), first.copy()
    jumps = np.zeros(len(flat), np.uint8)
    alone = int(ordered[ALONE]) if len(ordered) > ALONE else 0
    left = np.searchsorted(-ordered, -np.arange(alone), "left") if alone else ()
    for k in map(int, left):
        here = at[:k]
        jump = table[flat[here], i[:k] & mask]
        jumps[here] = jump
        i[:k] += jump
        here += 1
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(codes)
    for n, k in enumerate(order):
        done = min(alone, int(ordered[n])) if alone else 0
        ends = first[n] + np.cumsum(jumps[offsets[n]:offsets[n] + done], dtype=np.int64)
        if done < ordered[n]:
            e = int(ends[-1]) if done else int(first[n])
            rows = _ROWS[walk]
            rest = [e := e + rows[c][e & mask] for c in codes[k][done:].tobytes()]
            ends = np.concatenate([ends, np.array(rest, np.int64)])
        out[k] = ends
    return out


class Print:
    """Length of each walk and the characters it writes at the sampled steps."""

    def __init__(self, walks: list[tuple[int, np.ndarray]]):
        self.walks = walks

    @classmethod
    def of(cls, codes: np.ndarray, ends: list[np.ndarray]) -> Print:
        walks = []
        for w, own in enumerate(ends):
            length = int(own[-1]) if len(own) else 0
            walks.append((length, codes[np.searchsorted(own, sampled(length, w), "right")]))
        return cls(walks)

    def __str__(self) -> str:
        return "-".join(f"{length:x}.{symbols.tobytes().hex()}" for length, symbols in self.walks)

    @classmethod
    def parse(cls, written: str) -> Print:
        parts = [part.split(".") for part in written.split("-")]
        return cls([(int(n, 16), np.frombuffer(bytes.fromhex(x), np.uint8)) for n, x in parts])

    def likeness(self, other: Print) -> float:
        """Share of equal characters over the sampled steps of the longer walk, in the better of the walks (0 to 1)."""
        best = 0.0
        for w, (short, long) in enumerate(zip(self.walks, other.walks)):
            short, long = (short, long) if short[0] <= long[0] else (long, short)
            if long[0] == 0:
                return 1.0
            reached = sampled(long[0], w) < short[0]
            theirs = long[1][reached]
            best = max(best, float(np.count_nonzero(theirs == short[1][:len(theirs)])) / len(long[1]))
        return best


def bands(prints: list[Print]) -> np.ndarray:
    """Keys under which near-copies meet, a row per fingerprint: in each band of steps, the first ``ROWS`` sampled
    characters with their places (a band with fewer than ``FEWEST`` reads its walk's length too, so that only short
    equals meet)."""
    out = np.zeros((len(prints), WALKS, BANDS), np.int64)
    row = np.arange(len(prints))[:, None]
    for w in range(WALKS):
        at = np.full((len(prints), SAMPLES), -1, np.int64)
        read = np.zeros((len(prints), SAMPLES), np.uint64)
        for k, p in enumerate(prints):
            length, symbols = p.walks[w]
            at[k, :len(symbols)] = sampled(length, w)
            read[k, :len(symbols)] = symbols
        bits = mix64(at.astype(np.uint64) << np.uint64(8) | read)
        band = np.where(at < 0, BANDS, (mix64(at.astype(np.uint64) ^ np.uint64(0x5BD1E995)) % np.uint64(BANDS)).astype(np.int64))
        counts = np.zeros((len(prints), BANDS + 1), np.int64)
        np.add.at(counts, (row, band), 1)
        order = np.argsort(band, axis=1, kind="stable")
        band, bits = np.take_along_axis(band, order, 1), np.take_along_axis(bits, order, 1)
        starts = np.cumsum(counts, axis=1) - counts
        rank = np.arange(SAMPLES) - np.take_along_axis(starts, band, 1)
        table = np.zeros((len(prints), ROWS, BANDS), np.uint64)
        k, s = np.nonzero((rank < ROWS) & (band < BANDS))
        table[k, rank[k, s], band[k, s]] = bits[k, s]
        lengths = np.array([p.walks[w][0] for p in prints], np.uint64)[:, None]
        key = np.arange(w * BANDS, (w + 1) * BANDS, dtype=np.uint64) | np.where(
            counts[:, :BANDS] < FEWEST, lengths << np.uint64(16), np.uint64(0))
        for r in range(ROWS):
            key = mix64(key ^ table[:, r])
        out[:, w] = key.view(np.int64)
    return out.reshape(len(prints), -1)


def fingerprints(texts: list[str]) -> list[Print]:
    """The fingerprints of whole texts."""
    codes = [classes(t) for t in texts]
    ends = zip(*(steps(codes, w) for w in range(WALKS)))
    return [Print.of(c, e) for c, e in zip(codes, ends)]


def fingerprint(text: str | None) -> Print:
    """The fingerprint of a whole text; null is the empty text."""
    codes = classes(text or "")
    return Print.of(codes, [steps([codes], w)[0] for w in range(WALKS)])


def _with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` cut into ranges of descending doc_id: rows of (range, copy, doc_id, text), where each range
    also gets copies of the rows that come first in the next range (the last range those of the very first one).

    Ranges are cut at quantiles of the ids, at most four for each shuffle partition; the driver sees their bounds only.
    Null ids are a range of their own behind all others.
    """
    spark = docs.sparkSession
    n, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    parts = min(-(-n // RANGE_ROWS), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = []
    if low is not None and parts > 1:
        at = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
        cuts = sorted({x for x in at if low < x <= high}, reverse=True)
    bounds = -np.array(cuts, np.int64)

    def place(ids: pa.Array) -> np.ndarray:
        """Range r holds cuts[r - 1] > id >= cuts[r]."""
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, np.searchsorted(bounds, -ids.fill_null(0).to_numpy(), "left"), len(cuts) + 1)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"range": pa.array(place(batch.column(0)), pa.int32()), "first": batch.column(0)})
            yield from table.group_by("range").aggregate([("first", "max")]).rename_columns(["range", "first"]).to_batches()

    found = docs.select("doc_id").mapInArrow(heads, "range int, first long").groupBy("range").agg(F.max("first").alias("first"))
    firsts = sorted((r["range"], r["first"]) for r in found.collect())
    before = {firsts[k][0]: (firsts[k][1], firsts[k - 1][0]) for k in range(len(firsts))}

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "copy", "doc_id", "text"]
        for batch in batches:
            own = place(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.zeros(len(own), bool)), *batch.columns], names)
            first = [k for k, (r, x) in enumerate(zip(own.tolist(), batch.column(0).to_pylist())) if before[r][0] == x]
            if first:
                to = pa.array([before[int(own[k])][1] for k in first], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array([True] * len(first)), *batch.take(pa.array(first)).columns], names)

    return docs.mapInArrow(ranged, "range int, copy boolean, doc_id long, text string")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of an edited text: the last third replaced by the next one's beginning.

    One row per row of ``docs(doc_id, text)``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (likenesses with the edited text and with the next document), shared_edited and shared_next
    (bands in which they meet). Next is by descending doc_id, rows of one id by text, null ids last, after the last the
    first; a single row is its own next one. Null is the empty text. Texts are shuffled once, into ranges of ids; inside
    a range each row meets the one behind it in a sorted stream, so a task holds two texts at a time.
    """
    rows = (_with_next(docs.select(F.col("doc_id").cast("long"), "text")).repartition("range")
            .sortWithinPartitions("range", "copy", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "shared_edited", "shared_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            size = np.concatenate([[0], np.cumsum([len(r[3] or "") for r in rows])])
            for a, b in slices(size, CHARS):
                done, before = _compare(rows[a:b], before)
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [
                        pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int64()])], names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                           "edited_fingerprint string, near_edited double, near_next double, shared_edited long, shared_next long")


def _compare(rows: list[tuple], before: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Results of the rows that have a next one in their range, and the last row for the following call. An edited text
    shares the walk up to the edit, so only what is new is walked."""
    texts = [r[3] or "" for r in rows]
    codes = [classes(t) for t in texts]
    ends = list(zip(*(steps(codes, w) for w in range(WALKS))))
    held = ([] if before is None else [before]) + [
        (r[0], r[1], r[2], t, c, e, Print.of(c, e)) for r, t, c, e in zip(rows, texts, codes, ends)]
    pairs = [(a, b) for a, b in zip(held, held[1:]) if a[0] == b[0] and not a[1]]
    cut = [len(a[3]) - len(a[3]) // 3 for a, _ in pairs]
    new = [b[4][:len(a[3]) // 3] for a, b in pairs]
    walked = [steps(new, w, [int(a[5][w][k - 1]) if k else 0 for (a, _), k in zip(pairs, cut)]) for w in range(WALKS)]
    edits = [Print.of(np.concatenate([a[4][:k], added]), [np.concatenate([e[:k], t]) for e, t in zip(a[5], tails)])
             for (a, _), k, added, *tails in zip(pairs, cut, new, *walked)]
    keys = bands([a[6] for a, _ in pairs] + edits + [b[6] for _, b in pairs]).reshape(3, len(pairs), -1)
    shared = (keys[0] == keys[1]).sum(1), (keys[0] == keys[2]).sum(1)
    done = []
    for (a, b), k, edit, edited_bands, next_bands in zip(pairs, cut, edits, *shared):
        edited = a[3][:k] + b[3][:len(a[3]) - k]
        done.append((a[2], len(a[3]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(a[6]), str(edit),
                     a[6].likeness(edit), a[6].likeness(b[6]), int(edited_bands), int(next_bands)))
    return done, held[-1] if held else None


def _scan(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, salt, node, fingerprint) sorted by key and salt to (key, node, leader): each node under the first
    leader of its bucket that is near enough; a node without one leads from then on."""
    for table in groups(batches, 2):
        nodes, prints = table.column("node").to_pylist(), table.column("fingerprint").to_pylist()
        leaders: list[tuple[int, Print]] = []
        out = []
        for node, own in zip(nodes, map(Print.parse, prints)):
            found = next((n for n, p in leaders if p.likeness(own) >= least), None)
            if found is None:
                leaders.append((node, own))
            out.append(node if found is None else found)
        key = table.column("key").combine_chunks()
        yield pa.RecordBatch.from_arrays([key, pa.array(nodes, pa.int64()), pa.array(out, pa.int64())], ["key", "node", "leader"])


def near_documents(docs: DataFrame, least: float = SAME) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, fingerprint, component_id (smallest doc_id reachable) and kept.

    Documents meet where a band of their fingerprints agrees and are linked if the fingerprints' likeness confirms it.
    Equal fingerprints are one node (null and empty texts are equal too). In a bucket each node goes to the first leader
    that is near enough, so a bucket of copies costs one comparison a row; buckets beyond ``BLOCK_ROWS`` are dealt to
    several tasks whose leaders meet afterwards. A link between two nodes of different, unlinked leaders of one bucket
    shows in another band or not at all: classes are those of the leaders. Rows with a null doc_id have a null component_id.
    """
    ensure_checkpoint_dir(docs.sparkSession)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(str, fingerprints(texts_of(batch.column(1))))), pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(printed, "doc_id long, fingerprint string").checkpoint()
    node = F.xxhash64("fingerprint")
    nodes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).select(node.alias("node"), "least", "fingerprint")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = bands([Print.parse(x) for x in batch.column(1).to_pylist()])
            nodes = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])

    met = nodes.select("node", "fingerprint").mapInArrow(banded, "key long, node long").distinct()
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    salt = F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / BLOCK_ROWS))
    held = met.join(sizes, "key").select("key", salt.alias("salt"), "node", "n").join(nodes.select("node", "fingerprint"), "node")

    def scanned(held: DataFrame) -> DataFrame:
        return (held.select("key", "salt", "node", "fingerprint").repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
                .mapInArrow(lambda batches: _scan(batches, least), "key long, node long, leader long"))

    first = scanned(held).checkpoint()
    split = sizes.filter(F.col("n") > BLOCK_ROWS).select("key")
    heads = (first.filter("node = leader").join(split, "key", "left_semi").select("key", F.lit(0).alias("salt"), "node")
             .join(nodes.select("node", "fingerprint"), "node"))
    links = first.unionByName(scanned(heads)).filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    label = components(links)
    named = nodes.select("node", "least").join(label, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.join(ids, "label").select("node", "component_id")
    return rows.withColumn("node", node).join(found, "node").select(
        "doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        (F.col("doc_id") == F.col("component_id")).alias("kept"))
