"""Connected components of an undirected graph by contraction; all state lives in stage tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from braidset.session import discard, materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with an edge to another; ``root`` is some node of the component, the same for all its nodes.

    In a round every node hooks onto the neighbour of least priority (a hash, so that long paths shrink by a constant share),
    edges are renamed and made distinct; the rounds' maps are composed from the last to the first. Null ends and self-links
    are left out. The number of rounds follows the logarithm of the longest path, not the number of nodes.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    live = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        least = live.groupBy("u").agg(F.min(rank("v")).alias("least"))
        to = F.when(F.col("least") < rank("u"), F.col("least.n")).otherwise(F.col("u"))
        maps.append(materialize(least.select(F.col("u").alias("node"), to.alias("root")), "hooks"))
        left = maps[-1].select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = maps[-1].select(F.col("node").alias("v"), F.col("root").alias("rv"))
        renamed = live.join(left, "u").select("ru", "v").distinct().join(right, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        after = materialize(renamed.where("u <> v").distinct(), "edges")
        discard(live)
        live = after
    if not maps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def compose(final: DataFrame, earlier: DataFrame) -> DataFrame:
        onward = final.select(F.col("node").alias("root"), F.col("root").alias("last"))
        return earlier.join(onward, "root", "left").select("node", F.coalesce("last", "root").alias("root"))

    whole = materialize(reduce(compose, reversed(maps)), "components")
    discard(live, *maps)
    return whole
