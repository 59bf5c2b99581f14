"""Collocations of two and three words per language, counted in tiles of frequency-ranked ids.

A level is a table of phrases with their counts. The most frequent ones have their rank as id; neighbouring ids are pairs,
a pair is a place in a square tile of ranks, and a tile that a task fills well enough is counted by its addresses in a
dense array (``bincount``), the others as sorted coordinates. Frequent pairs are ranked again and are the ids of the next
level, whose pairs overlap in all words but one: a pair of pairs is a phrase of three words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .common import bytes_of, slices

#: Occurrences that make a phrase a candidate; ranks that are broadcast, of phrases of at most ``NAME`` bytes.
LEAST, RANKED, NAME = 10, 1 << 17, 64
#: Ids of a tile's side as a power of two; pairs of a tile from which it is counted densely.
SIDE, DENSE = 9, 1 << 14
#: Bytes of text that a task reads at once, pairs that it counts at once, distinct words and unranked ids that it holds.
RUN, PAIRS, HELD = 2 << 20, 1 << 20, 300_000
#: Bits of the filter that tells which unranked phrases can be candidates, and how many of them a phrase sets.
BITS, SET = 1 << 25, 2
#: Equal parts in which tasks' filters are joined.
SEGMENTS = 64
_NONE, _BREAK = -1, -2
#: Bits of one id inside a pair of ids.
_PAIR = 22
#: A-Z in lower case, signs that end a piece as line ends, tabs as spaces.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\r\x0b\x0c\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_COUNTS = "lang string, phrase string, n long"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of (lang, text) rows as words and line ends between them, language by language, some MB at a time."""
    for batch in batches:
        raw, offsets = bytes_of(batch.column(1))
        langs = ["und" if x is None else x for x in batch.column(0).to_pylist()]
        for a, b in slices(offsets, RUN):
            own: dict[str, list[bytes]] = {}
            for k in range(a, b):
                own.setdefault(langs[k], []).append(raw[offsets[k]:offsets[k + 1]].tobytes())
            for lang, texts in own.items():
                yield lang, b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


def count_words(docs: DataFrame) -> DataFrame:
    """Occurrences ``n`` of each (lang, phrase) of one word, and of all words of a lang in a row with phrase null."""

    def rows(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in seen.items():
            own.pop(b"", None), own.pop(b"\n", None)
            words, n = [w.decode() for w in own], list(own.values())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(n) + 1), pa.string()), pa.array([*words, None], pa.string()),
                                              pa.array([*n, sum(n)], pa.int64())], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for lang, words in _cells(batches):
            seen.setdefault(lang, Counter()).update(words)
            if sum(map(len, seen.values())) > HELD:
                yield from rows(seen)
                seen = {}
        yield from rows(seen)

    return docs.select("lang", "text").mapInArrow(run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def word_hash(lang: str, word: bytes) -> int:
    """The same 64 bits as Spark's ``xxhash64(lang, word)``."""
    return xxhash.xxh64_intdigest(word, lang_hash(lang))


def lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def joined_hash(first, last):
    """Hash of a pair from its words' hashes: the first with the last turned by 21 bits (arrays of unsigned 64 bits)."""
    return first ^ (last << np.uint64(21) | last >> np.uint64(43))


class Level:
    """What tasks know of one level: (lang, phrase) by rank with its count, and a filter of the phrases without a rank."""

    def __init__(self, names: list[tuple[str, bytes]], counts: np.ndarray, bits: np.ndarray | None):
        self.names, self.counts, self.bits = names, counts, bits
        self.raw = None if bits is None else bits.tobytes()

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """False where an unranked phrase of that hash is certainly no candidate."""
        found = np.full(len(hashes), self.bits is not None)
        for k in range(SET if self.bits is not None else 0):
            at = (hashes >> np.uint64(25 * k) & np.uint64(BITS - 1)).astype(np.int64)
            found &= (self.bits[at >> 3] & (1 << (at & 7))) != 0
        return found


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter of one task's hashes, as its segments that have any bit set."""
    held = np.zeros(BITS >> 5, np.uint32)
    for batch in batches:
        hashes = batch.column(0).to_numpy().view(np.uint64)
        for k in range(SET):
            at = (hashes >> np.uint64(25 * k) & np.uint64(BITS - 1)).astype(np.int64)
            np.bitwise_or.at(held, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
    parts = held.reshape(SEGMENTS, -1)
    found = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array([parts[k].tobytes() for k in found], pa.binary())], ["segment", "bits"])


def _joined_bits(table: pa.Table) -> pa.Table:
    """One segment of all tasks' filters."""
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint32) for x in table.column("bits").to_pylist()])
    return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


class Shared:
    """A level as a broadcast and as a table: ``tail`` holds (lang, phrase, n) of the phrases without a rank."""

    def __init__(self, level: DataFrame, hashed: Column):
        """Broadcast at most ``RANKED`` names of ``NAME`` bytes with counts, and ``BITS`` bits, of ``level(lang, phrase, n)``.

        Ranks follow n. Which phrases are ranked is decided by classes of n, eight to an octave, of which the lowest that
        would pass the bound is left to the filter. That filter lets a few others through, which are counted for nothing.
        """
        short = F.octet_length("phrase") + F.octet_length("lang") <= NAME
        octave = F.floor(F.log2("n") * 8)
        total, least = 0, None
        for row in sorted(level.filter(short).groupBy(octave.alias("o")).count().collect(), reverse=True):  # some hundred classes
            total += row["count"]
            if total > RANKED:
                break
            least = row["o"]
        ranked = short & (octave >= least) if least is not None else F.lit(False)
        top = level.filter(ranked).select("lang", "phrase", "n").toArrow().sort_by(
            [("n", "descending"), ("lang", "ascending"), ("phrase", "ascending")])
        names = list(zip(top.column("lang").to_pylist(), (x.encode() for x in top.column("phrase").to_pylist())))
        segment = "segment int, bits binary"
        found = (level.filter(~ranked).select(hashed.alias("h")).mapInArrow(_bits, segment)
                 .groupBy("segment").applyInArrow(_joined_bits, segment)).toArrow()  # BITS in all
        bits = None
        if found.num_rows:
            bits = np.zeros((SEGMENTS, (BITS >> 5) // SEGMENTS), "<u4")
            for k, part in zip(found.column("segment").to_pylist(), found.column("bits").to_pylist()):
                bits[k] = np.frombuffer(part, "<u4")
            bits = bits.reshape(-1).view(np.uint8)
        self.tail = level.filter(~ranked).select("lang", "phrase", "n")
        self.broadcast = level.sparkSession.sparkContext.broadcast((names, top.column("n").to_numpy(), bits))


class WordIds(dict):
    """Ids of one language's words: ranks, then numbers given as unranked words that may be candidates come up."""

    def __init__(self, lang: str, level: Level, names: list[tuple[str, bytes]]):
        self.lang, self.seed, self.names = lang, lang_hash(lang), names
        self.bits = level.raw
        super().__init__({b"": _NONE - 2, b"\n": _BREAK})

    def __missing__(self, word: bytes) -> int:
        found = _NONE
        if self.bits is not None:
            h = xxhash.xxh64_intdigest(word, self.seed)
            if all(self.bits[x >> 3] & (1 << (x & 7)) for x in (h >> 25 * k & BITS - 1 for k in range(SET))):
                found = len(self.names)
                self.names.append((self.lang, word))
        self[word] = found
        return found


class PairIds:
    """Ids of pairs of word ids, like :class:`WordIds`."""

    def __init__(self, level: Level, words: dict[str, WordIds], parts: list[tuple[str, bytes]]):
        self.level, self.parts, self.names = level, parts, list(level.names)
        codes = []
        for lang, phrase in level.names:
            a, b = (words[lang][w] if lang in words else _NONE for w in phrase.split(b" "))
            codes.append(a << _PAIR | b if a >= 0 and b >= 0 else -1)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = np.array(codes, np.int64)[order], order  # codes of -1 come first and are never looked up
        self.more: dict[int, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        found = (self.codes[at] == codes) & (codes >= 0) if len(self.codes) else np.zeros(len(codes), bool)
        ids = np.where(found, self.ranks[at] if len(self.codes) else _NONE, _NONE)
        if self.level.bits is not None:
            own, place = np.unique(codes[~found], return_inverse=True)
            ids[~found] = self._unranked(own)[place]
        return ids

    def _unranked(self, codes: np.ndarray) -> np.ndarray:
        """Ids of distinct codes (below 0: no pair) that have no rank."""
        new = self.parts[len(self.hashes):]
        self.hashes = np.concatenate([self.hashes, np.array([word_hash(*x) for x in new], np.uint64)])
        ids = np.full(len(codes), _NONE, np.int64)
        real = np.flatnonzero(codes >= 0)
        first, last = codes[real] >> _PAIR, codes[real] & (1 << _PAIR) - 1
        for k in real[self.level.may_hold(joined_hash(self.hashes[first], self.hashes[last]))].tolist():
            code = int(codes[k])
            if code not in self.more:
                (lang, a), (_, b) = self.parts[code >> _PAIR], self.parts[code & (1 << _PAIR) - 1]
                self.more[code] = len(self.names)
                self.names.append((lang, a + b" " + b))
            ids[k] = self.more[code]
        return ids


def count_tiles(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (left, right) and their counts: dense tiles by address, the others as sorted coordinates."""
    tile = (left >> SIDE) << 32 | right >> SIDE
    order = np.argsort(tile, kind="stable")
    left, right, tile = left[order], right[order], tile[order]
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(tile))
    dense = ends - starts >= DENSE
    out = []
    mask = (1 << SIDE) - 1
    for s, e in zip(starts[dense].tolist(), ends[dense].tolist()):
        n = np.bincount((left[s:e] & mask) << SIDE | right[s:e] & mask, minlength=1 << 2 * SIDE)
        at = np.flatnonzero(n)
        out.append(((left[s] & ~mask) | at >> SIDE, (right[s] & ~mask) | at & mask, n[at]))
    sparse = np.repeat(~dense, ends - starts)
    codes, n = np.unique(left[sparse] << 32 | right[sparse], return_counts=True)
    out.append((codes >> 32, codes & (1 << 32) - 1, n))
    return tuple(np.concatenate(x) for x in zip(*out))


_SENT = ["code", "lang", "left", "right", "n"]


def count_pairs(docs: DataFrame, words: Shared, pairs: Shared | None = None) -> DataFrame:
    """``lang``, ``left``, ``right``, ``n``: neighbouring phrases of a level (of words; with ``pairs``, of pairs that share
    a word) and how often they follow each other inside a piece, ``LEAST`` times or more.

    Tasks send their counts by ranks, or by name where a phrase has none; sums are exact either way.
    """
    word_cast, pair_cast = words.broadcast, pairs.broadcast if pairs is not None else None
    ranks = pair_cast if pair_cast is not None else word_cast

    def sent(left: np.ndarray, right: np.ndarray, names: list[tuple[str, bytes]], ranked: int) -> Iterator[pa.RecordBatch]:
        left, right, n = count_tiles(left, right)
        by_rank = (left < ranked) & (right < ranked)
        ranks_only = pa.RecordBatch.from_arrays([pa.array(left[by_rank] << 20 | right[by_rank]), pa.array(n[by_rank])], ["code", "n"])
        for a in range(0, len(ranks_only), 1 << 16):
            some = ranks_only.slice(a, 1 << 16)
            none = pa.nulls(len(some), pa.string())
            yield pa.RecordBatch.from_arrays([some.column(0), none, none, none, some.column(1)], _SENT)
        other = np.flatnonzero(~by_rank)
        if len(other):
            langs, phrases = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.binary()).cast(pa.string())
            for a in range(0, len(other), 1 << 16):
                some = other[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), langs.take(pa.array(left[some])),
                                                  *(phrases.take(pa.array(side[some])) for side in (left, right)), pa.array(n[some])], _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_level = Level(*word_cast.value)
        pair_level = Level(*pair_cast.value) if pair_cast is not None else None
        ids: dict[str, WordIds] = {}
        pair_ids, names, held = None, [], []

        def start() -> None:
            nonlocal ids, pair_ids, names
            ids.clear()  # before the new ones are built
            names = list(word_level.names)
            for k, (lang, word) in enumerate(names):
                if lang not in ids:
                    ids[lang] = WordIds(lang, word_level, names)
                ids[lang][word] = k
            if pair_level is not None:
                for lang, _ in pair_level.names:
                    ids.setdefault(lang, WordIds(lang, word_level, names))
                pair_ids = PairIds(pair_level, ids, names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                told = names if pair_ids is None else pair_ids.names
                yield from sent(*(np.concatenate(x) for x in zip(*held)), told, len((pair_level or word_level).names))
                held = []

        start()
        for lang, cells in _cells(batches):
            known = ids.setdefault(lang, WordIds(lang, word_level, names))
            at = np.fromiter(map(known.__getitem__, cells), np.int64, len(cells))
            at = at[at > _NONE - 2]
            if pair_ids is not None:
                inside = (at[:-1] >= 0) & (at[1:] >= 0)
                at = pair_ids.of(np.where(inside, at[:-1] << _PAIR | at[1:], -1))
            inside = (at[:-1] >= 0) & (at[1:] >= 0)
            held.append((at[:-1][inside], at[1:][inside]))
            full = len(names) + sum(map(len, ids.values())) + (len(pair_ids.names) if pair_ids else 0) > 3 * RANKED + HELD
            if full or sum(len(x) for x, _ in held) > PAIRS:
                yield from flush()
            if full:
                start()
        yield from flush()

    counts = (docs.select("lang", "text").mapInArrow(run, "code long, lang string, left string, right string, n long")
              .groupBy("code", "lang", "left", "right").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).checkpoint())

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ranks.value[0]
        for batch in batches:
            code = batch.column(0).to_numpy()
            left, right = (code >> 20).tolist(), (code & (1 << 20) - 1).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([names[x][0] for x in left], pa.string()),
                *(pa.array([names[x][1].decode() for x in side], pa.string()) for side in (left, right)), batch.column(1)], _SENT[1:])

    by_rank = counts.filter("code is not null").select("code", "n").mapInArrow(named, "lang string, left string, right string, n long")
    return by_rank.unionByName(counts.filter("code is null").select(*_SENT[1:]))


def _with_counts(df: DataFrame, keys: dict[str, str], level: Shared) -> DataFrame:
    """Add the counts of the phrases in columns ``keys`` under the names given. Ranked phrases, each of which may stand in
    many rows, are looked up in the broadcast; the others, each rare, come by a join on (lang, phrase), in which rows
    that need nothing take part under a key of their own that no phrase equals."""
    cast = level.broadcast

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, _ = cast.value
        known = dict(zip(names, counts.tolist()))
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            found = [pa.array([known.get((g, x.encode())) for g, x in zip(langs, batch.column(key).to_pylist())], pa.int64()) for key in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *keys.values()])

    out = df.mapInArrow(look_up, T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in keys.values())]))
    for key, name in keys.items():
        tail = level.tail.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias("_n"))
        sought = F.when(F.col(name).isNull(), F.col(key)).otherwise(F.concat(F.lit(" "), F.col("phrase")))
        out = (out.withColumn("_sought", sought).join(tail, (F.col("lang") == F.col("_lang")) & (F.col("_sought") == F.col("_phrase")), "left")
               .withColumn(name, F.coalesce(name, "_n")).drop("_lang", "_phrase", "_n", "_sought"))
    return out


def collocations(docs: DataFrame, top: int = 2_000) -> DataFrame:
    """The ``top`` phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs(lang, text)``: null texts are empty, a null lang is ``und``; A-Z are lower-cased; ``.,;:!?`` and line ends cut
    pieces, spaces and tabs words. A phrase with a = its occurrences >= ``LEAST`` is a candidate. Each cut into two parts
    has l and r, their occurrences, and the score floor(1,000,000 a a / (l r)); the lowest counts (of equals, the cut
    after fewer words). A pair is left out if a phrase of three that holds it occurs at least half as often. Order: score
    and a descending, phrase in byte order. Languages without candidates and empty tables give no rows; repeated rows
    count each. Every word and pair is counted; ranks and filters only say by which way.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    counted = count_words(docs).filter(F.col("phrase").isNull() | (F.col("n") >= LEAST)).checkpoint()
    words = Shared(counted.filter("phrase is not null"), F.xxhash64("lang", "phrase"))
    pairs = count_pairs(docs, words).select(
        "lang", F.concat_ws(" ", "left", "right").alias("phrase"), "n", F.col("left").alias("first"), F.col("right").alias("last")).checkpoint()
    turned = F.xxhash64("lang", "last")
    turned = F.shiftleft(turned, 21).bitwiseOR(F.shiftrightunsigned(turned, 43))
    ranked_pairs = Shared(pairs, F.xxhash64("lang", "first").bitwiseXOR(turned))
    last = F.substring_index("right", " ", -1)
    triples = count_pairs(docs, words, ranked_pairs).select(
        "lang", F.concat_ws(" ", "left", last).alias("phrase"), F.col("n").alias("a"), "left", "right",
        F.substring_index("left", " ", 1).alias("first"), last.alias("last")).checkpoint()

    held = (triples.select("lang", F.col("left").alias("phrase"), "a").unionByName(triples.select("lang", F.col("right").alias("phrase"), "a"))
            .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    two = pairs.join(held, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 50 * n").select(
        "lang", "phrase", F.col("n").alias("a"), "first", "last")
    two = _with_counts(two, {"first": "l", "last": "r"}, words).select("lang", "phrase", "a", "l", "r", _score("l", "r").alias("score"))
    three = _with_counts(_with_counts(triples, {"first": "l1", "last": "r2"}, words), {"left": "l2", "right": "r1"}, ranked_pairs)
    early = F.col("s1") <= F.col("s2")
    three = three.withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")}).select(
        "lang", "phrase", "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counted.filter("phrase is null").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score(left: str, right: str):
    """floor(1,000,000 a a / (left right)) in exact decimals (a below 10^15, so products stay below 10^38)."""
    a, l, r = (f"cast({c} as decimal(15,0))" for c in ("a", left, right))
    return F.expr(f"({a} * {a} * cast(1000000 as decimal(7,0))) div ({l} * {r})")
