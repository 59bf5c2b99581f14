"""Near-duplicate texts: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import groups, keeping_nothing, whole_row
from .components import components, stars
from .shingles import SLOTS, bands, shingle_sets, sketch, super_minhash

#: Signatures estimate a similarity with a standard deviation of about 0.03 at 0.75; pairs estimated below are left out:
#: of those at exactly 0.75 a share of at most 4e-10 (128 independent slots), beside 5e-6 that share no band.
ESTIMATE = 0.5
#: Members, and bytes of shingle sets, that one task holds of a group; larger groups are compared in blocks.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20

_SKETCHES = "doc_id long, n_shingles long, node binary, bands array<long>, sketch binary"


def _keys(sets: list[np.ndarray]) -> list[bytes | None]:
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: number of distinct shingles, a key of the set (``node``; null without words), band hashes, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1)):
                keys = _keys(sets)
                full = [i for i, k in enumerate(keys) if k]
                hashes, sketched = [None] * len(sets), [None] * len(sets)
                if full:
                    signatures = super_minhash([sets[i] for i in full])
                    for i, h, s in zip(full, bands(signatures), sketch(signatures)):
                        hashes[i], sketched[i] = h, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sketched, pa.binary())],
                    [c.split()[0] for c in _SKETCHES.split(", ")])
                at += len(sets)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(keeping_nothing(run), _SKETCHES)


def full_sets(docs: DataFrame) -> DataFrame:
    """``node`` and its whole sorted shingle set, for the rows that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in shingle_sets(batch.column(0)):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(_keys(sets), pa.binary()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])

    return docs.select("text").mapInArrow(keeping_nothing(run), "node binary, members binary").dropDuplicates(["node"])


class Union:
    """Union-find over 0..n-1, started from given labels."""

    def __init__(self, labels: list):
        first: dict = {}
        self.root = np.array([first.setdefault(x, i) for i, x in enumerate(labels)])

    def join(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        self.root[self.root == max(a, b)] = min(a, b)


def _blocks(n_blocks: str = "_n") -> Column:
    """The pairs (i, j), i <= j, of blocks in which block ``_own`` takes part, as an array."""
    both = F.sequence(F.lit(0), F.col(n_blocks) - 1)
    return F.transform(both, lambda k: F.struct(F.least(k, F.col("_own")).alias("i"), F.greatest(k, F.col("_own")).alias("j")))


def _partners(table: pa.Table) -> Iterator[tuple[int, int]]:
    """For a group sorted by block: each row and the first row it is compared with. Rows of two different blocks meet
    across them only; a block alone compares all of its rows."""
    own = table.column("_own").to_numpy()
    first = int(np.searchsorted(own, own[0], "right")) if own[0] != own[-1] else None
    if first is None and table.column("i")[0].as_py() != table.column("j")[0].as_py():
        return  # the other block is empty
    for i in range(len(own) - 1 if first is None else first):
        yield i, i + 1 if first is None else first


def candidate_edges(members: DataFrame) -> DataFrame:
    """What connects the pairs of each band bucket estimated at ``ESTIMATE`` or more, as stars (a, b) of each task.

    ``members(band, node, n_shingles, sketch)``. A bucket beyond ``BLOCK_ROWS`` is cut in blocks and every two blocks
    meet in one group, so that no pair is lost; a group yields fewer edges than it has members.
    """
    sizes = members.groupBy("band").count().select(F.col("band").alias("_band"),
                                                   F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("_n"))
    split = (members.join(sizes, F.col("band") == F.col("_band"))
             .withColumn("_own", F.pmod(F.hash("node"), F.col("_n")))
             .withColumn("_pair", F.explode(_blocks()))
             .select("band", "_pair.i", "_pair.j", "_own", "node", "n_shingles", "sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            node = table.column("node").to_pylist()
            size = table.column("n_shingles").to_numpy()
            marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
            least, weight, far = int(ESTIMATE * SLOTS), [], []
            for i, start in _partners(table):
                same = np.count_nonzero(marks[start:] == marks[i], axis=1)
                fits = (4 * np.minimum(size[start:], size[i]) >= 3 * np.maximum(size[start:], size[i])) & (same >= least)
                found = np.flatnonzero(fits)
                if len(found):
                    weight.append(same[found].astype(np.uint8))
                    far.append(np.stack([np.full(len(found), i, np.int32), (found + start).astype(np.int32)]))
            if not weight:
                continue
            weight, far = np.concatenate(weight), np.concatenate(far, axis=1)
            parent = list(range(len(node)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            out = []
            for k in np.argsort(SLOTS - weight, kind="stable"):
                a, b = root(int(far[0, k])), root(int(far[1, k]))
                if a != b:
                    parent[a] = b
                    out.append((node[far[0, k]], node[far[1, k]]))
                    if len(out) == len(node) - 1:
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()),
                                              pa.array([x for _, x in out], pa.binary())], ["a", "b"])

    # the forests of a task's buckets become stars in the same worker
    return (split.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "_own", "node")
            .mapInArrow(keeping_nothing(lambda batches: stars(run(batches))), "a binary, b binary"))


def verified_links(members: DataFrame, which: str) -> DataFrame:
    """Links (a, b) between members of one group whose labels differ, checked on full sets: 100 * common >= 75 * all.

    ``members(blob, label, node, sketch, members, _own, _n)``; ``which`` picks the pairs of blocks. Inside a group, pairs
    already connected are skipped, so the links are those that connect it.
    """
    chosen = {"own": "i = j", "first": "i = 0 AND j > 0", "all": "true"}[which]
    split = (members.withColumn("_pair", F.explode(_blocks()))
             .select("blob", "_pair.i", "_pair.j", "_own", "label", "node", "sketch", "members").filter(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            node = table.column("node").to_pylist()
            union = Union(table.column("label").to_pylist())
            sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
            size = np.array([len(s) for s in sets])
            # shingles of the group as small numbers: a row's own are marked, then looked up for many others at once
            _, ids = np.unique(np.concatenate(sets), return_inverse=True)
            sets, mine = np.split(ids, np.cumsum(size)[:-1]), np.zeros(ids.max() + 1, bool)
            marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
            least, out = int(ESTIMATE * SLOTS), []
            for i, start in _partners(table):
                other = np.flatnonzero(union.root[start:] != union.root[i]) + start
                other = other[4 * np.minimum(size[other], size[i]) >= 3 * np.maximum(size[other], size[i])]
                same = np.count_nonzero(marks[other] == marks[i], axis=1)
                order = np.argsort(-same, kind="stable")
                other = other[order[same[order] >= least]]
                mine[sets[i]] = True
                while len(other):
                    now, other = other[:64], other[64:]
                    starts = np.concatenate([[0], np.cumsum(size[now])[:-1]])
                    common = np.add.reduceat(mine[np.concatenate([sets[j] for j in now])], starts, dtype=np.int64)
                    for j in now[100 * common >= 75 * (size[i] + size[now] - common)]:
                        if union.root[j] != union.root[i]:
                            union.join(i, j)
                            out.append((node[i], node[j]))
                    other = other[union.root[other] != union.root[i]]
                mine[sets[i]] = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()),
                                                  pa.array([x for _, x in out], pa.binary())], ["a", "b"])

    return (split.repartition("blob", "i", "j").sortWithinPartitions("blob", "i", "j", "_own", "node")
            .mapInArrow(keeping_nothing(run), "a binary, b binary"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (least doc_id reachable over links), ``kept``.

    Sets are of 5 words (A-Z lower-cased), links have a Jaccard similarity of 0.75 or more. Rows with equal sets are one
    node, so copies are never compared. Nodes that share one of 32 bands of 4 slots and look alike by their sketches
    form blobs (a pair at 0.75 shares no band with a probability of 5e-6, and the estimate loses 4e-10 at most); within a
    blob, links are confirmed on full sets. A large blob goes in blocks: each block alone, then all against the first, which mostly connects it, and
    every two blocks only where parts are still apart.

    Texts without words (and null ones) link with nothing and keep their own id; rows repeated under one ``doc_id``
    share a component where their texts link; null ids never name a component; an empty table gives an empty table.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = sketches(docs).checkpoint()
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    # two keys make Spark exchange both sides, so that it can split the rows of a very large bucket
    counts = banded.groupBy("band").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("band").alias("_band"), F.xxhash64("band").alias("_hash"))
    shared = banded.join(counts, (F.col("band") == F.col("_band")) & (F.xxhash64("band") == F.col("_hash"))).select("node", "band")
    members = shared.join(nodes.select("node", "n_shingles", "sketch"), "node").select("band", "node", "n_shingles", "sketch")
    blobs = components(candidate_edges(members.checkpoint()), starred=True).withColumnRenamed("label", "blob")
    wanted = blobs.join(nodes, "node").select("node", "blob", "least", "sketch").checkpoint()
    texts = docs.join(wanted.select(F.col("least").alias("_least")).distinct(),
                      F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")
    sized = wanted.join(full_sets(texts), "node")
    n_blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.length("members")) / BLOCK_BYTES))
    sized = sized.checkpoint()
    counts = sized.groupBy("blob").agg(n_blocks.cast("int").alias("_n")).select(
        F.col("blob").alias("_blob"), F.xxhash64("blob").alias("_hash"), "_n")
    # two keys make Spark exchange both sides, so that it can split the rows of a very large blob
    sized = sized.join(counts, (F.col("blob") == F.col("_blob")) & (F.xxhash64("blob") == F.col("_hash"))).withColumn(
        "_own", F.pmod(F.hash("node"), F.col("_n")))
    sized = sized.select("blob", "node", "sketch", "members", "_own", "_n")
    links = verified_links(sized.withColumn("label", F.col("node")), "own").checkpoint()
    labels = components(links)
    for which in ("first", "all"):
        known = sized.filter("_n > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = known.groupBy("blob").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a <> _b")
        if apart.isEmpty():
            break
        more = verified_links(known.join(apart.select("blob"), "blob", "left_semi"), which)
        links = links.unionByName(more).checkpoint()
        labels = components(links)
    named = nodes.select("node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id")).select(
        F.col("label").alias("_label"), F.xxhash64("label").alias("_label_hash"), "component_id")
    # two keys make Spark exchange both sides, so that it can split the rows of a very large group
    found = named.join(ids, (F.col("label") == F.col("_label")) & (F.xxhash64("label") == F.col("_label_hash"))).select(
        F.col("node").alias("_node"), F.xxhash64("node").alias("_hash"), "component_id")
    out = (rows.select("doc_id", "n_shingles", "node")
           .join(found, (F.col("node") == F.col("_node")) & (F.xxhash64("node") == F.col("_hash")), "left"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the one document that ``near_duplicates`` keeps of each group.
    Columns of any name pass through: a row travels as one struct."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(whole_row(docs), F.col("doc_id").alias("id")).join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
