"""Reference remapping and reference tests between tables of a snapshot set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def remap(rows: DataFrame, scope: list[str], lineage: DataFrame, column: str, out: str) -> DataFrame:
    """Left join of a local reference to its global id; ``out`` is null when unresolved.

    ``lineage`` has ``[*scope, src, local_id, gid]``, one row per local id; the child side
    may be skewed, which the adaptive skew join splits.
    """
    ids = lineage.where("gid IS NOT NULL").select(
        *scope, "src", F.col("local_id").alias(column), F.col("gid").alias(out)
    )
    return rows.join(ids, [*scope, "src", column], "left")


def remap_any(rows: DataFrame, scope: list[str], targets: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Polymorphic reference: the first non-null column of ``targets`` decides kind and id.

    ``targets`` lists (kind, column, lineage). Adds ``kind`` (null when no target is set)
    and ``ref`` (null when unresolved) with a single join on (src, kind, local id).
    """
    kind = local = None
    for name, column, _ in targets:
        c = F.col(column)
        kind = F.when(c.isNotNull(), name) if kind is None else kind.when(c.isNotNull(), name)
        local = c if local is None else F.coalesce(local, c)
    known = reduce(
        DataFrame.unionByName,
        [
            ids.where("gid IS NOT NULL").select(
                *scope, "src", F.lit(name).alias("kind"), F.col("local_id").alias("_local"), F.col("gid").alias("ref")
            )
            for name, _, ids in targets
        ],
    )
    tagged = rows.withColumn("kind", kind).withColumn("_local", local)
    return tagged.join(known, [*scope, "src", "kind", "_local"], "left").drop("_local")


def dangling(child: DataFrame, keys: list[str], column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-null reference has no parent row."""
    ids = parent.select(*keys, F.col(parent_column).alias(column))
    return child.where(F.col(column).isNotNull()).join(ids, [*keys, column], "left_anti")


def unreferenced(parent: DataFrame, keys: list[str], parent_column: str, *children: tuple[DataFrame, str]) -> DataFrame:
    """Parent rows that no child column mentions."""
    return parent.join(mentioned(keys, parent_column, *children), [*keys, parent_column], "left_anti")


def referenced(parent: DataFrame, keys: list[str], parent_column: str, *children: tuple[DataFrame, str]) -> DataFrame:
    """Parent rows that some child column mentions."""
    return parent.join(mentioned(keys, parent_column, *children), [*keys, parent_column], "left_semi")


def mentioned(keys: list[str], out: str, *children: tuple[DataFrame, str]) -> DataFrame:
    """Distinct non-null ids in the given child columns."""
    parts = [df.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias(out)) for df, c in children]
    return reduce(DataFrame.unionByName, parts).distinct()


def with_children(parent: DataFrame, child: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Parent rows with aggregates over their children (null aggregates when there are none)."""
    return parent.join(child.groupBy(*keys).agg(*aggregates), keys, "left")
