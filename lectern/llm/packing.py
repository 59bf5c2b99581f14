"""Best-fit packing of token sequences after dominance reduction, on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir
from .common import texts_of
from .tokens import text_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Each text's ids, then ``end_id``, cut into pieces of ``capacity`` tokens where longer; null is the empty text."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = text_ids(path, text) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


@dataclass
class Bins:
    """``count`` equal bins; ``items`` are (length, how many) in the order in which they lie in each bin."""

    count: int
    room: int
    items: list[tuple[int, int]]


class Lengths:
    """How many pieces of each length are left, with the neighbours of a length among those left."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.order.pop(bisect_left(self.order, length))

    def at_most(self, length: int) -> int | None:
        i = bisect_left(self.order, length + 1)
        return self.order[i - 1] if i else None

    def smallest(self, n: int) -> list[int]:
        """The n smallest pieces left, repeats included."""
        out: list[int] = []
        for length in self.order:
            out += [length] * min(n - len(out), self.count[length])
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int) -> int:
        """The largest sum of two pieces left that is at most ``room`` (0: none)."""
        best, i, j = 0, 0, len(self.order) - 1
        while i <= j:
            total = self.order[i] + self.order[j]
            if total > room or i == j and self.count[self.order[i]] < 2:
                j -= 1
            else:
                best = max(best, total)
                i += 1
        return best


def reduce_dominated(left: Lengths, capacity: int) -> list[Bins]:
    """Fix bins that some best packing has (Martello and Toth): the set chosen for the longest piece dominates every
    other set it could share a bin with.

    For the longest piece, with room r: nothing fits beside it: it stays alone. A single piece fills r exactly, or at
    most one more piece fits, or no pair fits that holds more than the longest single fitting one while at most two
    more fit: it takes that single piece. Otherwise nothing is fixed and shorter pieces are tried. Equal cases are
    fixed at once, so the work depends on the number of different lengths, not on the number of documents.
    """
    fixed: list[Bins] = []
    for length in sorted(left.order, reverse=True):
        while left.count.get(length):
            room = capacity - length
            left.take(length, 1)  # its partner comes from the others
            single = left.at_most(room)
            least = left.smallest(3)
            alone = single is None
            partner = not alone and (
                single == room or len(least) < 2 or least[0] + least[1] > room
                or (len(least) < 3 or sum(least) > room) and left.best_pair(room) <= single)
            n = left.count.get(length, 0) + 1
            if alone:
                if n > 1:
                    left.take(length, n - 1)
                fixed.append(Bins(n, room, [(length, 1)]))
            elif partner:
                n = n // 2 if single == length else min(n, left.count[single])
                # what was true of the first is true of the equal ones after it: fewer pieces are left to choose from
                if single == length:
                    left.take(length, 2 * n - 1)
                    fixed.append(Bins(n, capacity - 2 * length, [(length, 2)]))
                else:
                    if n > 1:
                        left.take(length, n - 1)
                    left.take(single, n)
                    fixed.append(Bins(n, room - single, [(length, 1), (single, 1)]))
            else:
                left.count[length] = left.count.get(length, 0) + 1
                if left.count[length] == 1:
                    insort(left.order, length)
                break
    return fixed


def best_fit(left: Lengths, capacity: int) -> list[Bins]:
    """Best-fit decreasing over equal pieces at once: each goes to the fullest open bin that has room for it.

    The fullest fitting bin stays the fullest fitting one as long as another piece of the length fits, so each open
    bin takes as many as it can before the next one. Groups of equal bins split in at most three per step.
    """
    done: list[Bins] = []
    open_by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(bins: Bins) -> None:
        if not bins.count:
            return
        if bins.room == 0:
            done.append(bins)
            return
        if bins.room not in open_by_room:
            open_by_room[bins.room] = []
            insort(rooms, bins.room)
        open_by_room[bins.room].append(bins)

    for length in reversed(left.order):
        n = left.count[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length
                bins = Bins(-(-n // fit), capacity, [])
            else:
                room = rooms[i]
                bins = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(i)
                fit = room // length
            full = min(bins.count, n // fit)
            rest = min(fit, n - full * fit) if full < bins.count else 0
            put(Bins(bins.count - full - (rest > 0), bins.room, bins.items))
            put(Bins(full, bins.room - fit * length, [*bins.items, (length, fit)]))
            if rest:
                put(Bins(1, bins.room - rest * length, [*bins.items, (length, rest)]))
            n -= full * fit + rest
    return done + [b for group in open_by_room.values() for b in group]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[Bins]:
    """A packing of ``counts`` pieces of each length: fixed sets first, best-fit decreasing for what remains."""
    left = Lengths(counts)
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def _places(packed: list[Bins]) -> pd.DataFrame:
    """For each length, runs of its pieces (by rank): first rank, pieces per bin, first bin and offset there."""
    rows, used, first = [], {}, 0
    for bins in packed:
        offset = 0
        for length, each in bins.items:
            rows.append((length, used.get(length, 0), each, first, offset))
            used[length] = used.get(length, 0) + each * bins.count
            offset += length * each
        first += bins.count
    return pd.DataFrame(rows, columns=["length", "rank", "each", "bin", "offset"]).sort_values(["length", "rank"])


def ranked(cut: DataFrame, bucket_rows: int = 10_000) -> DataFrame:
    """``cut`` with ``_rank``, from 0 among the pieces of one length, by hash buckets so that no length fits one task."""
    n = cut.groupBy("length").count().select(F.col("length").alias("_l"), F.ceil(F.col("count") / bucket_rows).alias("_n"))
    # one row per length, at most as many as a sequence has tokens
    buckets = cut.join(F.broadcast(n), F.col("length") == F.col("_l")).withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_n"))).drop("_l", "_n")
    before = Window.partitionBy("_length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = buckets.groupBy("length", "_bucket").count().select(
        F.col("length").alias("_length"), F.col("_bucket").alias("_b"), "count")
    starts = sizes.select("_length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (buckets.withColumn("_row", F.row_number().over(inside) - 1)
            .join(starts, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b")))
            .withColumn("_rank", F.col("_start") + F.col("_row")).drop("_length", "_b", "_bucket", "_start", "_row"))


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and gapless ``offset``; empty texts have the end id alone.

    Only counts by length (at most ``capacity`` numbers) reach the driver, which packs them; the runs it gives back are
    broadcast (some thousand rows, bounded by the lengths), and each piece finds its place by its rank among the pieces
    of its length. Repeated rows are pieces of their own; an empty table gives an empty table.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    cut = pieces(docs, path, capacity, end_id).checkpoint()
    counts = {int(r["length"]): r["count"] for r in cut.groupBy("length").count().collect()}
    places = _places(pack_lengths(counts, capacity))
    width = np.int64(max(counts.values(), default=0) + 1)
    starts = places["length"].to_numpy(np.int64) * width + places["rank"].to_numpy(np.int64)
    each, first, offset = (places[c].to_numpy(np.int64) for c in ("each", "bin", "offset"))
    shared = docs.sparkSession.sparkContext.broadcast((starts, places["rank"].to_numpy(np.int64), each, first, offset))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, rank, each, first, offset = shared.value
        for batch in batches:
            length, own = batch["length"].to_numpy(np.int64), batch["_rank"].to_numpy(np.int64)
            i = np.searchsorted(starts, length * width + own, "right") - 1
            turn = own - rank[i]
            batch["sequence_id"] = first[i] + turn // each[i]
            batch["offset"] = offset[i] + turn % each[i] * length
            yield batch.drop(columns="_rank")

    return ranked(cut).mapInPandas(place, PIECES + ", sequence_id long, offset long")
