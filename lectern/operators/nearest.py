"""Nearest neighbours by cosine for a table of questions against a table of chunks.

Vectors are unit length, so cosine is the inner product. Scores are rounded to ``digits`` before ranking: the order
then does not depend on how the work was cut up, and ties go to the lower chunk id.

Every variant uses one physical shape. Chunks and questions carry a ``part`` (a scope, or a cell of the vector
space). Each part is cut into blocks of bounded size on both sides; a (chunk block, question block) pair is one
task-sized matrix product that emits at most ``k`` rows per question. No pair table exists anywhere, a part that holds
a third of all rows becomes many blocks, and a final window keeps the best ``k`` of the block winners.

Cells are cut level by level: a cell that is too large is split by centroids of its own, each level with its own radii.
A level is one shuffle of the vectors that still lie in large cells; centroids are rows of a table beside their parent,
so neither the driver nor a task holds more of them than one parent has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .parallel import broadcast_if_small

#: Rows of a chunk block, centroids that one cell is split by at most.
BLOCK, FAN = 2048, 1024
#: A question block has so many times the rows of a chunk block.
WIDE = 8
#: Chunks of a bin of cells about, which is what a question is sent to; a parent's cells are dealt to so many bins at least.
BIN, BINS = 32_768, 16
#: Questions scored at once against a block of chunks.
SLICE = 256


def _matrix(column) -> np.ndarray:
    """A list column as a float64 matrix, without Python objects."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(arr), -1)


def block_join(questions: DataFrame, chunks: DataFrame, kernel, schema: T.StructType, block: int = BLOCK,
               question_blocks: int = 1, least: int = 1) -> DataFrame:
    """Run ``kernel(question table, chunk table)`` on every pair of blocks that share a ``part``.

    Both inputs have a ``part`` column and an ``id``. The number of blocks of a part follows its size on each side; the
    table of part sizes is measured before it is broadcast. A chunk is copied once per question block of its part and the other way round; question blocks
    hold ``question_blocks`` times ``block`` rows, so that the larger table, the chunks, is seldom copied. A part of some
    thousand questions has ``least`` question blocks at least.
    """
    n_c = chunks.groupBy("part").agg(F.ceil(F.count("*") / block).alias("_nc"))
    n_q = questions.groupBy("part").agg(F.greatest(
        F.ceil(F.count("*") / (question_blocks * block)), F.least(F.ceil(F.count("*") / 1024), F.lit(least))).alias("_nq"))
    sizes = broadcast_if_small(n_c.join(n_q, "part"))

    def spread(df: DataFrame, mine: str, other: str, my_block: str, other_block: str) -> DataFrame:
        return (df.join(sizes, "part")
                .withColumn(my_block, F.pmod(F.xxhash64("id"), F.col(mine)))
                .withColumn(other_block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
                .withColumn("_key", F.concat_ws("/", F.col("part").cast("string"), "_cb", "_qb"))
                .select("_key", *(F.col(x).alias(x) for x in df.columns if x != "part")))  # fresh names: sides may share a table

    # one key column: the join's partitioning by part must not count as the grouping, or a part's blocks would all
    # land in one task
    q = spread(questions, "_nq", "_nc", "_qb", "_cb").groupBy("_key")
    c = spread(chunks, "_nc", "_nq", "_cb", "_qb").groupBy("_key")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({n: pa.array([], t) for n, t in arrow_types})
        return kernel(left, right)

    arrow_types = [(f.name, {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(),
                             "int": pa.int32(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()),
                             "array<float>": pa.list_(pa.float32()),
                             "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema]
    return q.cogroup(c).applyInArrow(run, schema)


def _reduced(*sides: np.ndarray) -> tuple[list[np.ndarray], float]:
    """The matrices in single precision, and by how much a product of two of their rows can differ; as they are where numbers are
    too large for that."""
    norms = [float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0))) for x in sides]
    most = norms[0] * norms[1]
    if not max(*norms, most) < 1e15:
        return list(sides), 1e-12 * most if most < np.inf else 0.0
    return [x.astype(np.float32) for x in sides], (sides[0].shape[1] + 8) * 2.0 ** -23 * most


def _topk_kernel(k: int, digits: int, exclude_self: bool):
    """Best k of a block pair. Products in single precision, by slices of questions and tiles of chunks, find the few pairs that
    can reach a question's k-th score so far (from ``_kth`` on, if the questions have one); their scores are double."""

    def kernel(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("id")
        cid, exact = c["id"].to_numpy(), _matrix(c["vec"])
        qid, asked = q["id"].to_numpy(), _matrix(q["vec"])
        (single, reduced), error = _reduced(asked, exact)
        error += 10.0 ** -digits
        bound = q["_kth"].to_numpy() if "_kth" in q.column_names else np.full(len(qid), -2.0)
        bound = np.where(bound > -2.0, bound, -np.inf)
        tiles = [(at, np.ascontiguousarray(reduced[at:at + TILE].T)) for at in range(0, len(cid), TILE)]
        out = []
        for at in range(0, len(qid), SLICE):
            mine = slice(at, min(at + SLICE, len(qid)))
            least, rows, cols, scores = bound[mine], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for first, tile in tiles:
                near = single[mine] @ tile
                if near.shape[1] > k:  # a tile has a k-th score of its own
                    unknown = np.flatnonzero(np.isneginf(least))
                    cut = near.shape[1] - k - exclude_self
                    least[unknown] = np.partition(near[unknown], cut, axis=1)[:, cut] - error
                r, col = np.divmod(np.flatnonzero(near >= (least - error)[:, None]), near.shape[1])
                col += first
                if exclude_self:
                    other = qid[mine][r] != cid[col]
                    r, col = r[other], col[other]
                score = np.round(np.einsum("ij,ij->i", asked[mine][r], exact[col]), digits)
                rows, cols, scores = np.concatenate([rows, r]), np.concatenate([cols, col]), np.concatenate([scores, score])
                best = _first_of(rows, scores, cols, k)
                rows, cols, scores = rows[best], cols[best], scores[best]
                last = np.searchsorted(rows, np.arange(len(least)), side="right")
                full = np.flatnonzero(last - np.searchsorted(rows, np.arange(len(least))) == k)
                least[full] = np.maximum(least[full], scores[last[full] - 1])
            out.append(pa.table({"question_id": qid[mine][rows], "chunk_id": cid[cols], "score": scores}))
        return pa.concat_tables(out)

    return kernel


HITS = T.StructType([T.StructField("question_id", T.LongType()), T.StructField("chunk_id", T.LongType()),
                     T.StructField("score", T.DoubleType())])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _sides(questions: DataFrame, chunks: DataFrame, part_q, part_c) -> tuple[DataFrame, DataFrame]:
    # fresh aliases: both sides may come from the same table
    q = questions.select(F.col("question_id").cast("bigint").alias("id"), F.col("vec").alias("vec"),
                         part_q.alias("part"))
    c = chunks.select(F.col("chunk_id").cast("bigint").alias("id"), F.col("vec").alias("vec"), part_c.alias("part"))
    return q, c


def _numbers(df: DataFrame):
    """The ``vec`` column as single or double precision, as it comes; whatever else it holds becomes double."""
    vec = F.col("vec")
    return vec if df.schema["vec"].dataType.elementType == T.FloatType() else F.transform(vec, lambda x: x.cast("double"))


def _rows(vectors: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = vectors.shape
    return pa.ListArray.from_arrays(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32)[:n + 1] if d else np.zeros(n + 1, np.int32),
                                    vectors.astype(np.float64).ravel())


def _directions(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


class CellTree:
    """Cells of cells: ``leaves`` (id, vec, part, bin) of all chunks, and per level a table of its cells, by parent.

    A level's rows: ``part`` (the parent's path), ``id`` (number of the child), ``child`` (its path), ``vec`` (centroid),
    ``size``, ``radius`` (angle), ``leaf``, ``bin``. A parent's leaves are dealt to bins of about ``BIN`` chunks: however small
    the cells, a question is sent to few bins, once to each. Built by at most log(chunks) / log(FAN) rounds. A cell that its own centroids
    do not split further (copies of one vector) stays a leaf of any size, which the block join cuts.
    """

    def __init__(self, chunks: DataFrame, cell_size: int):
        """``chunks``: id, vec, part (roots of the tree: one for all, or one per scope)."""
        ensure_checkpoint_dir(chunks.sparkSession)
        self.levels: list[DataFrame] = []
        leaves = []
        rest = chunks.select("id", _numbers(chunks).alias("vec"), F.col("part").cast("string").alias("part"))
        sizes = rest.groupBy("part").agg(F.count("*").alias("_n"))
        self.roots = sizes
        most = sizes.agg(F.max("_n")).first()[0] or 0
        cell_size = max(cell_size, min(BIN, -(-most // BINS)))  # smaller cells would only be put together again in bins
        while True:
            large = sizes.filter(F.col("_n") > cell_size)
            if large.isEmpty():
                leaves.append(rest.withColumn("bin", F.col("part")))
                break
            level, inside = self._split(rest.join(broadcast_if_small(large), "part"), cell_size)
            self.levels.append(level)
            leaves.append(rest.join(broadcast_if_small(large.select("part")), "part", "left_anti").select("id", "vec", "part", F.col("part").alias("bin")))
            ends = broadcast_if_small(level.select(F.col("child").alias("part"), "leaf", "bin"))
            inside = inside.join(ends, "part").checkpoint()
            leaves.append(inside.filter("leaf").select("id", "vec", "part", "bin"))
            rest = inside.filter(~F.col("leaf")).select("id", "vec", "part")
            sizes = level.filter(~F.col("leaf")).select(F.col("child").alias("part"), F.col("size").alias("_n"))
        self.leaves = leaves[0]
        for more in leaves[1:]:
            self.leaves = self.leaves.unionByName(more)

    @staticmethod
    def _split(rows: DataFrame, cell_size: int) -> tuple[DataFrame, DataFrame]:
        """One level: its cells, and the rows (id, vec, part) in them. Centroids are a bounded sample in hash order."""
        order = Window.partitionBy("part").orderBy(F.xxhash64("id", "part"), "id")
        fan = F.least(F.lit(FAN), F.ceil(F.col("_n") / cell_size) + 1)
        picked = (rows.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= FAN + 1) & (F.col("_r") <= fan))
                  .select("part", F.col("_r").cast("bigint").alias("id"), "vec", F.col("_n").alias("_of")).checkpoint())

        def nearest(q: pa.Table, c: pa.Table) -> pa.Table:
            c = c.sort_by("id")
            centroids = _directions(_matrix(c["vec"]))
            out = []
            for at in range(0, q.num_rows, BLOCK):
                piece = q.slice(at, BLOCK)
                cos = _matrix(piece["vec"]) @ centroids.T
                best = cos.argmax(axis=1)
                paths = pa.array([f"{p}.{k}" for p, k in zip(piece["_path"].to_pylist(), c["id"].to_numpy()[best].tolist())], pa.string())
                out.append(pa.table({"id": piece["id"], "vec": piece["vec"], "part": paths, "_cos": cos[np.arange(len(best)), best]}))
            return pa.concat_tables(out)

        schema = T.StructType([T.StructField("id", T.LongType()), rows.schema["vec"], T.StructField("part", T.StringType()),
                               T.StructField("_cos", T.DoubleType())])
        inside = block_join(rows.withColumn("_path", F.col("part")).drop("_n"), picked.drop("_of"), nearest, schema, 2 * FAN, WIDE).checkpoint()
        found = inside.groupBy("part").agg(F.count("*").alias("size"), F.min("_cos").alias("_least"))
        child = F.concat_ws(".", "part", F.col("id").cast("string"))
        held = F.greatest(F.lit(cell_size), F.least(F.lit(BIN), F.ceil(F.col("_of") / BINS)))
        upto = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)  # at most FAN cells
        level = (picked.withColumn("child", child).join(found.withColumnRenamed("part", "child"), "child")
                 .withColumn("radius", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_least") - 1e-12))))
                 .withColumn("leaf", (F.col("size") <= cell_size) | (F.col("size") == F.col("_of")))
                 .withColumn("bin", F.concat("part", F.lit("/"), F.floor((F.sum("size").over(upto) - F.col("size")) / held).cast("string")))
                 .select("part", "id", "child", "vec", "size", "radius", "leaf", "bin").checkpoint())
        return level, inside.drop("_cos")

    def visits(self, questions: DataFrame, need: int | None, slack: float = 0.0) -> DataFrame:
        """One row per (question, bin to open): id, vec, part (the bin), _kth. ``questions``: id, vec, part (a root), ``_kth``.

        With ``need``, at each level the nearest cells that together hold so many chunks; without it, every cell whose
        best possible cosine reaches ``_kth``.
        """

        def choose(q: pa.Table, c: pa.Table) -> pa.Table:
            c = c.sort_by("id")
            centroids, radius = _directions(_matrix(c["vec"])), c["radius"].to_numpy()
            size = c["size"].to_numpy()
            # where a cell leads to: its bin, or its own cells
            goal = [b if end else child for b, end, child in zip(c["bin"].to_pylist(), c["leaf"].to_pylist(), c["child"].to_pylist())]
            goals, place = np.unique(np.array(goal, object), return_inverse=True)
            leaf = np.zeros(len(goals), bool)
            leaf[place] = c["leaf"].to_numpy(zero_copy_only=False)
            by_goal = place.argsort(kind="stable")
            first = np.searchsorted(place[by_goal], np.arange(len(goals)))
            goals = pa.array(goals.tolist(), pa.string())
            out = []
            for at in range(0, q.num_rows, SLICE):
                piece = q.slice(at, SLICE)
                angles = np.arccos(np.clip(_matrix(piece["vec"]) @ centroids.T, -1.0, 1.0))
                if need is not None:
                    order = angles.argsort(axis=1, kind="stable")
                    chosen = np.zeros(angles.shape, bool)
                    np.put_along_axis(chosen, order, np.cumsum(size[order], axis=1) - size[order] < need, axis=1)
                else:
                    chosen = np.cos(np.maximum(angles - radius, 0.0)) + slack >= piece["_kth"].to_numpy()[:, None]
                row, at_goal = np.nonzero(np.logical_or.reduceat(chosen[:, by_goal], first, axis=1))
                picked = piece.select(["id", "vec", "_kth"]).take(pa.array(row))
                out.append(picked.append_column("part", goals.take(pa.array(at_goal))).append_column("leaf", pa.array(leaf[at_goal])))
            return pa.concat_tables(out)

        rest = questions.select("id", _numbers(questions).alias("vec"), "_kth", F.col("part").cast("string").alias("part"))
        schema = T.StructType([T.StructField("id", T.LongType()), rest.schema["vec"], T.StructField("_kth", T.DoubleType()),
                               T.StructField("part", T.StringType()), T.StructField("leaf", T.BooleanType())])
        split = self.levels[0].select("part").distinct() if self.levels else None
        out = []
        for level in self.levels:
            if split is not None:  # roots without children are leaves
                out.append(rest.join(broadcast_if_small(split), "part", "left_anti"))
                split = None
            opened = block_join(rest, level, choose, schema, 2 * FAN).checkpoint()
            out.append(opened.filter("leaf").drop("leaf"))
            rest = opened.filter(~F.col("leaf")).drop("leaf")
        if not self.levels:
            out.append(rest)
        found = out[0].select("id", "vec", "part", "_kth")
        for more in out[1:]:
            found = found.unionByName(more.select("id", "vec", "part", "_kth"))
        return found


def dense_topk(questions: DataFrame, chunks: DataFrame, k: int, scope: str | None = None, digits: int = 6,
               exclude_self: bool = False, block: int = BLOCK, cell_size: int = 8 * BLOCK) -> DataFrame:
    """Exact best ``k`` chunks per question: question_id, chunk_id, score, rank.

    Inputs: ``question_id, vec`` and ``chunk_id, vec`` (integer ids). With ``scope`` both sides are equi-joined on
    that column before any scoring. A scope (or the whole table) of more than ``cell_size`` chunks is cut into cells of
    cells: a first pass over the nearest cells gives each question a k-th score, and a second pass visits only the cells
    that can reach it (triangle inequality on angles), so the result stays exact.
    """
    kernel = _topk_kernel(k, digits, exclude_self)
    held = max(block, 2 * BIN)
    root = F.lit(0) if scope is None else F.col(scope)
    q, c = _sides(questions, chunks, root.cast("string"), root.cast("string"))
    tree = CellTree(c, cell_size)
    if not tree.levels:
        return _ranked(block_join(q, c, kernel, HITS, held, least=32), k)
    need = 4 * k + 1
    parts = tree.leaves.select("id", "vec", F.col("bin").alias("part"))
    first = block_join(tree.visits(q.withColumn("_kth", F.lit(-2.0)), need), parts, kernel, HITS, held, least=4)
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    kth = (first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k)
           .select(F.col("question_id").alias("id"), F.col("score").alias("_kth")))
    bounded = q.join(kth, "id", "left").withColumn("_kth", F.coalesce("_kth", F.lit(-2.0)))
    return _ranked(block_join(tree.visits(bounded, None, 2 * 10.0 ** -digits), parts, kernel, HITS, held, least=4), k)


#: Chunks that codebooks are trained on at most (hash order), cells of the first level, dimensions of one code byte.
TRAINED, COARSE, SUB = 16_384, 512, 4
#: Chunks of a bin of cells of the approximate search about, chunks that give ``refine * k`` candidates at least.
HELD, TILE = 131_072, 8_192


def _lloyd(points: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """k-means centres of ``points``, started from rows at equal steps; empty centres keep their place."""
    centres = points[np.linspace(0, len(points) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        near = (points @ centres.T - 0.5 * (centres ** 2).sum(1)).argmax(1)
        count = np.bincount(near, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


class ResidualCodes:
    """Coarse cells, and per ``SUB`` dimensions of what is left after subtracting the cell's centre a book of 256 vectors."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        dims = sample.shape[1]
        self.centres = _lloyd(sample, min(n_cells, len(sample)))
        residual = sample - self.centres[self.nearest(sample)]
        self.cuts = [(a, min(a + SUB, dims)) for a in range(0, dims, SUB)]
        self.books = [_lloyd(residual[:, a:b], min(256, len(sample))) for a, b in self.cuts]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.centres.T - 0.5 * (self.centres ** 2).sum(1)).argmax(1)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.nearest(vectors)
        residual = vectors - self.centres[cell]
        codes = [(residual[:, a:b] @ book.T - 0.5 * (book ** 2).sum(1)).argmax(1) for (a, b), book in zip(self.cuts, self.books)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes of one cell stand for, in single precision."""
        out = np.repeat(self.centres[cell].astype(np.float32)[None, :], len(codes), axis=0)
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            out[:, a:b] += book.astype(np.float32)[codes[:, m]]
        return out


def _candidates(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indexes of each row's best ``k``, ties to the lower column. A sample of the columns gives a bound that few
    of the others reach, so whole rows are only compared with it."""
    n = scores.shape[1]
    if n <= k:
        rows, cols = np.indices(scores.shape)
        return rows.ravel(), cols.ravel()
    step = max(1, n // 1024)
    sample = scores[:, ::step]
    rank = min(sample.shape[1], 5 * k // (4 * step) + 6)
    bound = np.partition(sample, sample.shape[1] - rank, axis=1)[:, sample.shape[1] - rank]
    reach = scores >= bound[:, None]
    few = np.flatnonzero(np.count_nonzero(reach, axis=1) < k)
    if len(few):
        whole = np.nan_to_num(scores[few], nan=-np.inf)
        reach[few] = whole >= np.partition(whole, n - k, axis=1)[:, n - k][:, None]
    rows, cols = np.divmod(np.flatnonzero(reach), n)
    best = _first_of(rows, scores[rows, cols], cols, k)
    return rows[best], cols[best]


def ann_topk(questions: DataFrame, chunks: DataFrame, k: int, n_probe: int = 8, n_cells: int | None = None,
             scope: str | None = None, digits: int = 6, exclude_self: bool = False, refine: int = 8,
             block: int = HELD, tile: int = TILE) -> DataFrame:
    """Approximate best ``k`` by residual product quantisation, the best ``refine * k`` re-ranked by exact cosine.

    Codebooks are trained on at most ``TRAINED`` chunks; every chunk is indexed. Each question looks into the ``n_probe``
    cells (of at most ``COARSE``) with the nearest centres. Cells are dealt to bins of about ``block`` chunks (a larger cell
    is cut into blocks) and a question is sent once to each bin that holds one of its cells, so what is shuffled grows with
    questions times bins, not times cells or candidates. Codes give candidates of every ``tile`` chunks of a cell, which are
    re-ranked where they are found, by the vectors that stand beside the codes: at most ``k`` rows of a question leave a bin,
    and a larger table has no fewer candidates a chunk. A scope is answered exactly instead: filtering after an approximate
    search loses rows.
    """
    if scope is not None:
        return dense_topk(questions, chunks, k, scope, digits, exclude_self)
    spark = chunks.sparkSession
    q, c = _sides(questions, chunks, F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    q, c = (x.select("id", _numbers(x).alias("vec")) for x in (q, c))
    sample = c.orderBy(F.xxhash64("id"), "id").limit(TRAINED).select("vec").toArrow()  # training only
    if not sample.num_rows:
        return dense_topk(questions, chunks, k, None, digits, exclude_self)
    vectors = _matrix(sample["vec"])
    codes = ResidualCodes(vectors, min(COARSE, n_cells or max(1, round(math.sqrt(len(vectors))))))
    shared = spark.sparkContext.broadcast(codes)
    # neighbouring cells share a bin, by their sizes in the sample; at most COARSE numbers
    total = c.count()
    held = np.bincount(codes.nearest(vectors), minlength=len(codes.centres)) * (total / len(vectors))
    bins = spark.sparkContext.broadcast((np.cumsum(held) - held) // block)
    n_bins = len(np.unique(bins.value))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, code = shared.value.encode(_matrix(b.column("vec")))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(cell.astype(np.int32)), pa.array([x.tobytes() for x in code], pa.binary()),
                                              pa.array(bins.value[cell].astype(np.int64))], ["id", "vec", "cell", "code", "part"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = _matrix(b.column("vec")) @ shared.value.centres.T
            keep = min(n_probe, sims.shape[1])
            near = np.sort(np.argpartition(-sims, keep - 1, axis=1)[:, :keep], axis=1).astype(np.uint16)
            for part in np.unique(bins.value):
                inside = bins.value[near] == part
                rows = np.flatnonzero(inside.any(axis=1))
                cells = pa.array([near[r, inside[r]].tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), b.column("vec").take(pa.array(rows)), cells,
                                                  pa.array(np.full(len(rows), int(part)))], ["id", "vec", "cells", "part"])

    wanted = refine * k

    def look_up(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by([("cell", "ascending"), ("id", "ascending")])
        cid, exact, cell = c["id"].to_numpy(), _matrix(c["vec"]), c["cell"].to_numpy()
        code = np.frombuffer(b"".join(c["code"].to_pylist()), np.uint8).reshape(len(cid), -1)
        qid, asked = q["id"].to_numpy(), _matrix(q["vec"])
        single = asked.astype(np.float32)
        probed = np.zeros((len(qid), len(shared.value.centres)), bool)
        for i, cells in enumerate(q["cells"].to_pylist()):
            probed[i, np.frombuffer(cells, np.uint16)] = True
        rows, cols, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        kth = np.full(len(qid), -np.inf)  # the k-th score of a stretch of chunks, which others must reach
        ends = np.searchsorted(cell, np.arange(len(shared.value.centres) + 1))
        for n in np.unique(cell).tolist():
            visitors = np.flatnonzero(probed[:, n])
            for a in range(int(ends[n]), int(ends[n + 1]), tile):
                b = min(a + tile, int(ends[n + 1]))
                decoded = shared.value.decode(n, code[a:b]).T
                for at in range(0, len(visitors), SLICE):
                    own = visitors[at:at + SLICE]
                    at_chunk = _candidates(single[own] @ decoded, wanted + exclude_self)[1].reshape(len(own), -1) + a  # as many for each
                    score = np.round(np.matmul(exact[at_chunk], asked[own][:, :, None])[:, :, 0], digits)
                    if exclude_self:
                        score[qid[own][:, None] == cid[at_chunk]] = -np.inf
                    if score.shape[1] >= k:
                        kth[own] = np.maximum(kth[own], np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
                    r, c_at = np.nonzero((score >= kth[own][:, None]) & (score > -np.inf))
                    rows.append(own[r])
                    cols.append(at_chunk[r, c_at])
                    found.append(score[r, c_at])
        rows, cols, found = np.concatenate(rows), np.concatenate(cols), np.concatenate(found)
        best = _first_of(rows, found, cid[cols], k)
        return pa.table({"question_id": qid[rows[best]], "chunk_id": cid[cols[best]], "score": found[best]})

    vec = q.schema["vec"].dataType.simpleString()
    coded = c.mapInArrow(encode, f"id bigint, vec {c.schema['vec'].dataType.simpleString()}, cell int, code binary, part bigint")
    visits = q.mapInArrow(probe, f"id bigint, vec {vec}, cells binary, part bigint")
    return _ranked(block_join(visits, coded, look_up, HITS, block, least=max(4, 32 // n_bins)), k)


def _first_of(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of each row number, ties to the lower id."""
    order = np.lexsort((ids, -scores, rows))
    own = rows[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def doc_boost(hits: DataFrame, questions: DataFrame, doc_vecs: DataFrame, boost: float, k: int,
              doc: str = "doc_id", digits: int = 6) -> DataFrame:
    """Re-sort hits by score + boost x cosine(question, document summary) and keep ``k``.

    ``hits`` are over-fetched (max(k, candidate_k) per question). A document without a summary vector counts 0; the
    reported ``score`` stays the chunk's own cosine.
    """
    from ..functions.vectors import dot

    h = (hits.drop("rank").join(questions.select("question_id", F.col("vec").alias("_q")), "question_id")
         .join(doc_vecs.select(doc, F.col("vec").alias("_d")), doc, "left"))
    doc_score = F.when(F.col("_d").isNull(), 0.0).otherwise(dot(F.col("_q"), F.col("_d")))
    h = h.withColumn("doc_score", F.round(doc_score, digits)).drop("_q", "_d")
    h = h.withColumn("_key", F.round(F.col("score") + boost * F.col("doc_score"), digits))
    w = Window.partitionBy("question_id").orderBy(F.desc("_key"), F.desc("score"), "chunk_id")
    return h.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_key")
