"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinelens.llm._store import settle

#: Links per partition (two numbers each) at least; rounds of fewer links run in one, without a shuffle.
PARTITION_LINKS = 1_000_000


def _size(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def _with_least(rows: DataFrame, alone: bool) -> DataFrame:
    """``rows`` with the least ``v`` of their ``u``; a join would shuffle rows of a single partition, too."""
    if alone:
        return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return rows.join(rows.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (long columns ``a``, ``b``); a root is its smallest node.

    Each round joins every node's neighbours to the smallest of them, first the larger neighbours, then the
    smaller; the rounds grow with the logarithm of the nodes. Minima are map-side aggregates, so a node with
    very many neighbours is no bottleneck; what fits one partition is left there. A round runs in as many partitions as its links need; its joins are
    merges, so its minima never pass through the driver. Loops and repeated links are ignored; no links give no rows.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size = _size(edges)
    while size[0]:
        parts = -(-size[0] // PARTITION_LINKS)
        both = edges.coalesce(parts).selectExpr("inline(array(named_struct('u', u, 'v', v), named_struct('u', v, 'v', u)))")
        edges = _with_least(both, parts == 1).where("v > u").selectExpr("v AS u", "least(m, u) AS v").distinct()
        hung = _with_least(edges, parts == 1).selectExpr("inline(array(named_struct('u', u, 'v', m), named_struct('u', v, 'v', m)))")
        edges = settle(hung.where("u <> v").distinct())
        before, size = size, _size(edges)
        if size == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return settle(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``links`` and of those that gave ``found``, which stands for its links as one star per root."""
    stars = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.union(links.select("a", "b")))
