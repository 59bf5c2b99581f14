"""Near-duplicate vectors: an exact metric range join over pivot cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import groups
from .components import components
from .minhash import _blocks

#: Vectors meant for one cell, pivots of all labels together at most (they are broadcast), vectors of one block.
CELL, MOST_PIVOTS, BLOCK = 4096, 2048, 2048
_ITEMS = "vec_id long, key binary, label long, dim int, unit binary"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Per row: the vector scaled to length 1 in double precision and a key of label and vector; null where it can't
    link (null, empty or zero vectors, null or non-finite components, null labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            keys, units = [], []
            for label, size, end in zip(batch.column(2).to_pylist(), sizes, ends):
                v = values[end - size:end]
                if label is None or not size or not np.isfinite(v).all() or not v.any():
                    keys.append(None)
                    units.append(None)
                    continue
                v = v / np.abs(v).max()
                units.append((v / np.sqrt(v @ v)).tobytes())
                keys.append(hashlib.blake2b(b"%d:" % label + units[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), batch.column(2), pa.array(sizes, pa.int32()),
                 pa.array(units, pa.binary())], [c.split()[0] for c in _ITEMS.split(", ")])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"),
                          F.col("label").cast("long")).mapInArrow(run, _ITEMS)


def pivots_of(items: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Pivots of each (label, dim) that needs more than one cell: its items of least key, so many that a cell holds
    ``CELL`` of them, and ``MOST_PIVOTS`` in all."""
    sizes = items.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    cell = max(CELL, -(-total // (MOST_PIVOTS // 2)))
    large = sizes.filter(F.col("n") > cell).select("label", "dim", F.ceil(F.col("n") / cell).alias("_k"), "n")
    # keys are hashes, so a range of them is a random sample; twice the expected number is enough to choose from
    share = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("double") / float(1 << 32)
    near = items.join(F.broadcast(large), ["label", "dim"]).filter(share <= 4 * F.col("_k") / F.col("n") + 1e-9)
    found: dict[tuple[int, int], list] = {}
    for r in near.select("label", "dim", "_k", "key", "unit").orderBy("label", "dim", "key").collect():
        own = found.setdefault((r["label"], r["dim"]), [])
        if len(own) < r["_k"]:
            own.append(np.frombuffer(r["unit"]))
    return {k: np.stack(v) for k, v in found.items()}


def in_cells(items: DataFrame, radius: float) -> DataFrame:
    """Each item in the cell of its nearest pivot (``own``), and as a visitor in every later cell that can hold an item
    within ``radius`` of it.

    If y lies within the radius of x and in the cell of q, then by the triangle inequality d(x, q) <= d(x, p) +
    2 * radius for x's own pivot p. In Euclidean space the distance of x to the plane between p and q,
    (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)), is at most the radius too, which is sharper. A pair of cells meets once,
    in the later one.
    """
    shared = items.sparkSession.sparkContext.broadcast(pivots_of(items))
    schema = "label long, dim int, cell int, key binary, own boolean, weight long, unit binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slack = 1e-9
        for batch in batches:
            rows, cells, own = [], [], []
            for i, (label, dim, unit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "unit")))):
                points = shared.value.get((label, dim))
                if points is None:
                    rows.append(i), cells.append(0), own.append(True)
                    continue
                x = np.frombuffer(unit)
                square = ((points - x) ** 2).sum(1)
                p = int(square.argmin())
                apart = np.sqrt(((points - points[p]) ** 2).sum(1))
                near = (np.sqrt(square) <= np.sqrt(square[p]) + 2 * radius + slack) & (
                    square - square[p] <= 2 * apart * radius + slack)
                near = np.flatnonzero(near)
                near = near[near > p]
                rows += [i] * (1 + len(near))
                cells += [p, *near.tolist()]
                own += [True] + [False] * len(near)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column("label"), taken.column("dim"), pa.array(cells, pa.int32()), taken.column("key"),
                 pa.array(own, pa.bool_()), taken.column("weight"), taken.column("unit")],
                [c.split()[0] for c in schema.split(", ")])

    return items.mapInArrow(run, schema)


def joined_cells(cells: DataFrame, cosine: float) -> DataFrame:
    """Rows (a, b, n): with b null, n vectors linked with item a found in one group; else a link.

    Every two blocks of a cell meet in one group of bounded size. It yields one count per item and a spanning forest of
    its links, never its pairs. Pairs of visitors are left to their own cells.
    """
    sizes = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")).select(
        F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("cell").alias("_c"), "_n")
    split = (cells.join(sizes, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_c")))
             .withColumn("_own", F.pmod(F.hash("key"), F.col("_n"))).withColumn("_pair", F.explode(_blocks()))
             .select("label", "dim", "cell", "_pair.i", "_pair.j", F.col("_own").alias("block"), "key", "own", "weight", "unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 5):
            key = table.column("key").to_pylist()
            block, own = table.column("block").to_numpy(), table.column("own").to_numpy()
            weight = table.column("weight").to_numpy()
            x = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(key), -1)
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            if i == j:
                left = right = np.arange(len(key))
                links = x @ x.T >= cosine
                np.fill_diagonal(links, False)
            else:
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                links = x[left] @ x[right].T >= cosine
            links &= own[left][:, None] | own[right][None, :]
            n = np.zeros(len(key), np.int64)
            n[left] += links @ weight[right]
            if i != j:
                n[right] += weight[left] @ links
            both = np.zeros((len(key), len(key)), bool) if i != j else links
            if i != j:
                both[np.ix_(left, right)] = links
                both[np.ix_(right, left)] = links.T
            out, seen = [], np.zeros(len(key), bool)
            for start in np.flatnonzero(n):
                if seen[start]:
                    continue
                seen[start], todo = True, [start]
                while todo:
                    at = todo.pop()
                    new = np.flatnonzero(both[at] & ~seen)
                    seen[new] = True
                    todo += new.tolist()
                    out += [(key[at], key[k], None) for k in new]
            out += [(key[k], None, int(n[k])) for k in np.flatnonzero(n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(
                    (pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "n"])

    keys = ["label", "dim", "cell", "i", "j"]
    return split.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary, n long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Per row: ``vec_id``, ``n_links`` (vectors linked directly), ``component_id`` (least vec_id reachable), ``kept``.

    Vectors link when their labels are equal and their cosine is at least ``cosine``, that is, when their unit vectors
    lie within sqrt(2 - 2 cosine). Equal vectors of a label are one item with a weight. Vectors that can't link keep their
    own id and 0 links; null ids never name a component; only vectors of one length are compared; an empty table gives
    an empty table.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = unit_vectors(vectors).checkpoint()
    items = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"),
        F.count("*").alias("weight"), F.min("vec_id").alias("least")).checkpoint()
    cells = in_cells(items.select("label", "dim", "key", "weight", "unit"), float(np.sqrt(2 - 2 * cosine))).checkpoint()
    found = joined_cells(cells, cosine).checkpoint()
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    labels = components(found.filter("b IS NOT NULL")).withColumnRenamed("node", "key").withColumnRenamed("label", "root")
    named = items.select("key", "weight", "least").join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id")).select(
        F.col("root").alias("_root"), F.xxhash64("root").alias("_root_hash"), "component_id")
    of_root = (F.col("root") == F.col("_root")) & (F.xxhash64("root") == F.col("_root_hash"))
    per_item = named.join(ids, of_root).join(counts, "key", "left").select(
        F.col("key").alias("_key"), F.xxhash64("key").alias("_hash"), "component_id",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # two keys make Spark exchange both sides, so that it can split the rows of a very large group
    out = rows.select("vec_id", "key").join(
        per_item, (F.col("key") == F.col("_key")) & (F.xxhash64("key") == F.col("_hash")), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
