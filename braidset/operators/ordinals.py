"""Dense numbering that never sorts a whole group, or the whole table, in one task.

A group of bounded size is numbered by a window. For larger ones, and for whole tables, rows are range-partitioned by
the order columns, so a hot group is spread over as many partitions as its size needs; a row's number is its place in its
partition plus the size of the partitions before, and only one count per partition is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from braidset.session import materialize

#: Rows of a group that one task sorts.
SORTED = 100_000
#: Buckets in which groups are counted together before they are counted one by one.
_BUCKETS = 1 << 16
_PART_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def _spread(df: DataFrame, order: list[str], name: str, hold: list[str] | None = None) -> DataFrame:
    """Range-partitioned, sorted rows with ``_part`` and ``_place``, fixed as a table of the columns ``hold`` (all if not given)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*(hold or df.columns))
    fixed = materialize(ranged.withColumn("_ord_row", F.monotonically_increasing_id()), name)
    return fixed.withColumn("_ord_part", F.shiftright("_ord_row", _PART_BITS)).withColumn(
        "_ord_place", F.col("_ord_row") - F.shiftleft("_ord_part", _PART_BITS)
    ).drop("_ord_row")


def _with_number(spread: DataFrame, out: str) -> DataFrame:
    # One row per partition of the sort: bounded by the partition count, so a single
    # window over it and a broadcast of it are safe whatever the data size.
    sizes = spread.groupBy("_ord_part").agg(F.count("*").alias("_ord_n"))
    before = Window.orderBy("_ord_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_ord_part", F.coalesce(F.sum("_ord_n").over(before), F.lit(0)).alias("_ord_start"))
    return spread.join(F.broadcast(starts), "_ord_part").withColumn(
        out, F.col("_ord_start") + F.col("_ord_place") + 1
    ).drop("_ord_start", "_ord_place")


def global_ordinal(df: DataFrame, order: list[str], out: str, keep_part: bool = False, hold: list[str] | None = None) -> DataFrame:
    """1, 2, 3, ... over the whole DataFrame in the given (total) order; of its columns only ``hold`` are kept if given."""
    numbered = _with_number(_spread(df, order, "ordinal", hold), out)
    return numbered if keep_part else numbered.drop("_ord_part")


def ordinal_within(df: DataFrame, group: list[str], order: list[str], out: str, keep_part: bool = False) -> DataFrame:
    """1, 2, 3, ... inside each group; ``group`` columns must not be null."""
    if not group:
        return global_ordinal(df, order, out, keep_part)
    if keep_part:
        return _ranged_within(df, group, order, out, True)
    # Groups that one task can sort are numbered where they are grouped; only the others are ranged over partitions.
    crowded = crowded_groups(df, group, SORTED)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")
    if crowded is None:
        return df.withColumn(out, place)
    spread = _ranged_within(df.join(crowded, group, "left_semi"), group, order, out, False)
    return df.join(crowded, group, "left_anti").withColumn(out, place).unionByName(spread)


def crowded_groups(df: DataFrame, group: list[str], limit: int) -> DataFrame | None:
    """Groups of more than ``limit`` rows, None if there are none.

    A group has no more rows than its bucket, and buckets are counted without moving rows; only if a bucket is over the limit are
    groups counted one by one.
    """
    bucket = F.pmod(F.xxhash64(*group), F.lit(_BUCKETS)).alias("_bucket")
    if df.groupBy(bucket).agg(F.count("*").alias("_ord_n")).where(F.col("_ord_n") > limit).isEmpty():
        return None
    sizes = df.groupBy(*group).agg(F.count("*").alias("_ord_n")).where(F.col("_ord_n") > limit)
    crowded = materialize(sizes.select(*group), "crowded-groups")
    return None if crowded.isEmpty() else crowded


def _ranged_within(df: DataFrame, group: list[str], order: list[str], out: str, keep_part: bool) -> DataFrame:
    numbered = global_ordinal(df, [*group, *[c for c in order if c not in group]], "_ord_number", True)
    firsts = numbered.groupBy(*group).agg(F.min("_ord_number").alias("_ord_first"))
    ranked = numbered.join(firsts, group).withColumn(out, F.col("_ord_number") - F.col("_ord_first") + 1)
    return ranked.drop("_ord_number", "_ord_first") if keep_part else ranked.drop("_ord_number", "_ord_first", "_ord_part")


def running_max(df: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """Running maximum of ``value`` by ``order`` inside each group.

    ``df`` must come from ``ordinal_within(..., keep_part=True)`` over the same group,
    so (group, partition) is never more than one partition's rows; maxima of the
    partitions before are carried in from one row per (group, partition).
    """
    carry = df.groupBy(*group, "_ord_part").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*group).orderBy("_ord_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*group, "_ord_part", F.max("_top").over(earlier).alias("_carry"))
    local = Window.partitionBy(*group, "_ord_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("_local", F.max(value).over(local)).join(carry, [*group, "_ord_part"])
    return joined.withColumn(out, F.greatest("_local", "_carry")).drop("_local", "_carry")


def top_rows(df: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """The first rows of each group; Spark prunes to ``limit`` rows per task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= limit)
