"""Hard-negative mining: cover trees over all vectors, searched by a stated set of anchors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.llm import cover_tree
from spinelens.llm._store import importable, stored
from spinelens.llm.spill_runs import packed, unpacked

#: Vector components of a tree at most.
TREE_VALUES = 1 << 20
#: Trees are dealt to so many searchers per batch of anchors, whatever their number.
SEARCHERS = 16
#: Anchors of a batch at most, and their vector components. Each batch is handed all trees.
BATCH, BATCH_VALUES = 1 << 16, 1 << 22
#: Anchors of a batch that search a tree together, and their vector components.
GROUP, GROUP_VALUES = 2048, 1 << 17
#: Anchors whose lists are put together at a time.
PART = 1024
#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1

_ROWS = "tree bigint, place int, id bigint, label bigint, vector array<bigint>, data binary"
_HITS = "array<struct<minus: bigint, id: bigint>>"


def _planted(vectors: DataFrame, scale: int, partitions: int) -> DataFrame:
    """A row per tree (``data``), and a row per anchor with its place (tree and number) among the points, whose components are scaled to integers."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20

        def planted(parts: list[tuple]) -> pa.RecordBatch:
            ids, labels, anchors = (np.concatenate([p[i] for p in parts]) for i in range(3))
            points = np.zeros((len(ids), max(1, max(p[3].max(initial=0) for p in parts))), np.int64)
            at = 0
            for _, _, _, lens, flat in parts:
                row = np.repeat(np.arange(len(lens)), lens)
                points[at + row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
                at += len(lens)
            tree = cover_tree.build(points, ids, labels)
            chosen = np.flatnonzero(anchors)
            n = len(chosen)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(n + 1, number)), pa.array([*chosen.tolist(), None], pa.int32()),
                pa.array([*ids[chosen].tolist(), None], pa.int64()), pa.array([*labels[chosen].tolist(), None], pa.int64()),
                pa.array([*(points[i].tolist() for i in chosen), None], pa.list_(pa.int64())),
                pa.array([None] * n + [cover_tree.frame(tree, points, ids, labels)], pa.binary())],
                names=["tree", "place", "id", "label", "vector", "data"])

        parts, width, rows = [], 1, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                vector = batch.column("vector").slice(at)
                lens = np.diff(vector.offsets.to_numpy())
                grown = np.maximum.accumulate(np.maximum(lens, width))
                fits = int(((rows + 1 + np.arange(len(lens))) * grown <= TREE_VALUES).sum())
                take = min(len(lens), max(fits, 0 if rows else 1))
                if take:
                    piece = vector.slice(0, take)
                    parts.append((batch.column("id").slice(at, take).to_numpy(), batch.column("label").slice(at, take).to_numpy(),
                                  np.asarray(batch.column("anchor").slice(at, take)), lens[:take], np.floor(float(scale) * piece.flatten().to_numpy()).astype(np.int64)))
                    rows, width, at = rows + take, int(grown[take - 1]), at + take
                if at < batch.num_rows:
                    yield planted(parts)
                    parts, width, rows, number = [], 1, 0, number + 1
        if parts:
            yield planted(parts)

    dealt = vectors.repartitionByRange(partitions, "label", F.xxhash64("id", "vector")).withColumn("vector", F.col("vector").cast("array<double>"))
    return stored(dealt.mapInArrow(work, _ROWS), "trees")


class _Anchors:
    """Anchors of a batch, by label, tree and place, with their lists: of positives, or of negatives per window."""

    def __init__(self, rows: list[tuple], positives: int, negatives: int, low: int, high: int, first: bool):
        tree, place, label, lens, flat, counts, windows = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((place, tree, label))
        self.tree, self.place, self.label = tree[order], place[order], label[order]
        n, none = len(order), (cover_tree.MOST, cover_tree.LEAST)
        least, most = (np.full((n, 1 if first else positives), x) for x in (none[::-1] if first else none))
        if not first:  # percents of scores without products beyond 64 bits
            at = np.repeat(np.argsort(order), counts), np.arange(len(windows)) - np.repeat(np.cumsum(counts) - counts, counts)
            whole, rest = np.divmod(windows, 100)
            least[at], most[at] = low * whole - -low * rest // 100, high * whole + high * rest // 100
            least[least > most], most[least > most] = none
        self.lists = cover_tree.Lists(positives if first else negatives, least, most)
        lens, starts = lens[order], (np.cumsum(lens) - lens)[order]
        self.groups, at = [], 0
        while at < n:
            width = np.maximum(np.maximum.accumulate(lens[at : at + GROUP]), 1)
            end = at + max(1, int((np.arange(1, len(width) + 1) * width <= GROUP_VALUES).sum()))
            some = lens[at:end]
            vectors = np.zeros((end - at, int(max(1, some.max()))), flat.dtype)
            row, part = np.repeat(np.arange(end - at), some), np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            vectors[row, part] = flat[starts[at:end][row] + part]
            self.groups.append(cover_tree.Queries(vectors, at))
            at = end

    def positives(self, number: int, tree: cover_tree.Tree) -> None:
        def others(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return (self.tree[who] != number) | (self.place[who] != tree.order[rows])

        labels = np.unique(tree.labels)
        starts, ends = (np.searchsorted(self.label, labels, side) for side in ("left", "right"))
        for i in np.flatnonzero(starts < ends).tolist():
            for group in self.groups:
                some = np.arange(max(starts[i] - group.start, 0), min(ends[i] - group.start, len(group.vectors)))
                if len(some):
                    tree.find(group, self.lists, some, int(labels[i]), others, 1)

    def negatives(self, _: int, tree: cover_tree.Tree) -> None:
        only = int(tree.labels[0]) if (tree.labels == tree.labels[0]).all() else None

        def others(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return self.label[who] != tree.labels[np.searchsorted(tree.first, rows, "right") - 1]

        for group in self.groups:
            some = np.arange(len(group.vectors))
            if only is not None:
                some = some[self.label[group.start : group.start + len(some)] != only]
            if len(some):
                tree.find(group, self.lists, some, None, others if only is None else None)

    def found(self) -> Iterator[tuple[int, bytes]]:
        """The lists so far, of some anchors at a time."""
        self.lists.settle()
        held = np.arange(self.lists.k) < self.lists.count[:, :, None]
        for part, at in enumerate(range(0, len(self.tree), PART)):
            some = slice(at, at + PART)
            yield part, packed(self.tree[some], self.place[some], self.lists.count[some].reshape(-1),
                               self.lists.scores[some][held[some]], self.lists.ids[some][held[some]])


def _searched(anchors: DataFrame, trees: DataFrame, batches: int, positives: int, negatives: int, low: int, high: int, first: bool) -> DataFrame:
    """Per batch, some of its anchors at a time, and searcher: the first rows found for each of their lists, as bytes.

    Anchors look for their positives ``first`` (one list), then for negatives in the windows of their positives' scores.
    A searcher takes its trees one after the other and keeps the lists of one batch of anchors.
    """
    batch = F.pmod(F.xxhash64("tree", "place"), F.lit(batches)).cast("int")
    searcher = F.explode(F.sequence(F.lit(0), F.lit(SEARCHERS - 1)))
    left = anchors.select("tree", "place", "label", "vector", "windows", F.lit(None).cast("binary").alias("data"),
                          batch.alias("batch"), searcher.alias("searcher"))
    one = F.pmod(F.shiftright("tree", 20) + F.col("tree").bitwiseAND((1 << 20) - 1), F.lit(SEARCHERS)).cast("int")
    right = trees.select("tree", F.lit(None).cast("int").alias("place"), F.lit(None).cast("bigint").alias("label"),
                         F.lit(None).cast("array<bigint>").alias("vector"), F.lit(None).cast("array<bigint>").alias("windows"), "data",
                         F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), one.alias("searcher"))
    cell = F.col("batch") * SEARCHERS + F.col("searcher")
    dealt = left.unionByName(right).repartitionById(batches * SEARCHERS, cell).sortWithinPartitions(F.col("data").isNotNull())

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, anchors, batch = [], None, 0
        for part in parts:
            if part.column("data").null_count:
                are = part.filter(part.column("data").is_null())
                batch, vector, windows = are.column("batch")[0].as_py(), are.column("vector"), are.column("windows")
                waiting.append((are.column("tree").to_numpy(), are.column("place").to_numpy(), are.column("label").to_numpy(),
                                np.diff(vector.offsets.to_numpy()), cover_tree.small(vector.flatten().to_numpy()),
                                np.diff(windows.offsets.to_numpy()), windows.flatten().to_numpy()))
                are = vector = windows = None
            if waiting and part.column("data").null_count < part.num_rows:
                anchors, waiting = _Anchors(waiting, positives, negatives, low, high, first), []
            if anchors is not None:
                look = anchors.positives if first else anchors.negatives
                for number, data in zip(part.column("tree"), part.column("data")):
                    if data.is_valid:
                        look(number.as_py(), cover_tree.Tree(data.as_buffer()))
        if anchors is not None:
            for at, found in anchors.found():
                yield pa.RecordBatch.from_pydict({"batch": pa.array([batch], pa.int32()), "part": pa.array([at], pa.int32()), "found": [found]})

    return dealt.mapInArrow(work, "batch int, part int, found binary")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each list over all searchers."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((key, found) for b in batches for *key, found in zip(*(b.column(c).to_pylist() for c in ("batch", "part", "found"))))
        for _, same in groupby(rows, key=itemgetter(0)):
            frames = [unpacked(found) for _, found in same]
            tree, place = frames[0][:2]
            lists = len(frames[0][2]) // len(tree)
            who = np.concatenate([np.repeat(np.arange(len(f[2])), f[2]) for f in frames])
            scores, ids = (np.concatenate([f[i] for f in frames]) for i in (3, 4))
            order, rank = cover_tree.ranked(who, scores, ids)
            order = order[rank < k]
            some, starts = np.unique(who[order], return_index=True)
            hits = pa.StructArray.from_arrays([pa.array(-scores[order]), pa.array(ids[order])], names=["minus", "id"])
            yield pa.RecordBatch.from_arrays([
                pa.array(tree[some // lists]), pa.array(place[some // lists], pa.int32()), pa.array(some % lists, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)], pa.int32()), hits)], names=["tree", "place", "list", "hits"])

    dealt = found.repartition("batch", "part").sortWithinPartitions("batch", "part")
    return dealt.mapInArrow(work, f"tree bigint, place int, list int, hits {_HITS}")


def mine(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         anchor: str | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30,
         high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; scores are integer inner products, exact. An anchor's positives are its first
    ``positives`` other rows of the same label, its negatives for each of them the first ``negatives`` rows of other
    labels with ``low`` to ``high`` percent of the positive's score. Higher scores come first, ties by smaller id.
    ``anchor`` is a condition on the table's columns that says which rows are anchors (all, if None).

    All rows are dealt by label into cover trees of bounded size, kept in the shared checkpoint folder. Anchors search in
    batches of up to ``BATCH``; ``SEARCHERS`` tasks share the trees of each batch, read one tree after the other and return
    short lists, whose number grows with the anchors only. The anchors of a group descend a tree together: nodes are left
    out by their bounds per anchor, what remains is scored by products of matrices. Equal vectors of a label are one point
    of a tree, so a vector that a third of all rows have costs one look.

    Rows with a null label or vector, or with null or non-finite components take no part. Null ids come last among ties
    and are returned as null; repeated rows are rows of their own (an anchor leaves out itself only); shorter vectors, also
    empty ones, count as filled up with zeros; an empty table, or one without anchors, gives no rows. Scaled components
    and scores have to fit 64 bits. Further columns are read only by ``anchor``.
    """
    spark = vectors.sparkSession
    importable(spark)
    name = f"`{vector_col}`"
    whole = f"`{label_col}` IS NOT NULL AND {name} IS NOT NULL AND NOT exists({name}, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))"
    rows = vectors.where(whole).select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.coalesce(F.expr(anchor or "true"), F.lit(False)).alias("anchor"),
        F.col(name).alias("vector"))
    values = vectors.agg(F.sum(F.greatest(F.size(F.col(name)), F.lit(1))).cast("long")).first()[0] or 0
    planted = _planted(rows, scale, max(SEARCHERS, -(-2 * values // TREE_VALUES)))
    trees, anchors = planted.where("place IS NULL").select("tree", "data"), planted.where("place IS NOT NULL").drop("data")
    count, values = anchors.agg(F.count("*"), F.sum(F.greatest(F.size("vector"), F.lit(BATCH_VALUES // BATCH))).cast("long")).first()
    batches = max(1, -(-count // BATCH), -(-(values or 0) // BATCH_VALUES))
    limits = positives, negatives, low, high
    found = _first(_searched(anchors.withColumn("windows", F.array().cast("array<bigint>")), trees, batches, *limits, True), positives)
    near = stored(anchors.join(found.drop("list"), ["tree", "place"]), "positives")
    again = near.withColumn("windows", F.expr("transform(hits, h -> -h.minus)")).drop("hits")
    hard = _first(_searched(again, trees, batches, *limits, False), negatives)
    told = near.select("tree", "place", F.col("id").alias("anchor"), F.posexplode("hits").alias("list", "positive"))
    out = told.join(hard, ["tree", "place", "list"]).select("anchor", "positive", F.posexplode("hits").alias("rank", "negative"))
    return out.select(
        F.expr(f"nullif(anchor, {NO_ID})").alias("anchor_id"), F.expr(f"nullif(positive.id, {NO_ID})").alias("positive_id"),
        (F.col("rank") + 1).alias("rank"), F.expr(f"nullif(negative.id, {NO_ID})").alias("negative_id"),
        F.expr("-positive.minus").alias("positive_score"), F.expr("-negative.minus").alias("negative_score"))
