"""Renumbering: appended positions, slots, colliding paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from braidset.functions.hashing import stable_guid
from braidset.functions.text import file_extension, path_key
from braidset.operators.ordinals import ordinal_within, running_max
from braidset.session import materialize


def append_positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """New positions: rows of the first contributor keep theirs, all others are appended.

    ``rows`` has ``first_contributor`` (boolean) and ``Position``; ``order`` is total inside a
    group, first contributor first and by position there. A repeated position of the first
    contributor moves just above the highest one so far, to 0 at least.
    """
    mine = rows.where("first_contributor")
    # Nothing ever moves below 0, so the first row of a negative position keeps it, and its repeats queue up from 0
    # before all rows that are not negative.
    firsts = mine.where("Position < 0").groupBy(*group, "Position").agg(F.min(F.struct(*order)).alias("_first"))
    split = mine.join(firsts, [*group, "Position"], "left")
    keeps = (F.col("Position") < 0) & (F.struct(*order) == F.col("_first"))
    below = split.where(keeps).withColumn("new_position", F.col("Position").cast("bigint")).drop("_first")
    queued = ordinal_within(split.where(~F.coalesce(keeps, F.lit(False))).drop("_first"), group, order, "_k", keep_part=True)
    queued = queued.withColumn("_lead", F.greatest(F.col("Position"), F.lit(0)) - F.col("_k"))
    queued = running_max(queued, group, "_k", "_lead", "_top").withColumn("new_position", (F.col("_top") + F.col("_k")).cast("bigint"))
    mine = below.select(*rows.columns, "new_position").unionByName(queued.select(*rows.columns, "new_position"))
    base = mine.groupBy(*group).agg(F.greatest(F.max("new_position"), F.lit(-1)).alias("_base"))
    rest = ordinal_within(rows.where("NOT first_contributor"), group, order, "_k")
    rest = rest.join(base, group, "left").withColumn(
        "new_position", F.coalesce("_base", F.lit(-1)) + F.col("_k")
    ).drop("_base", "_k")
    return mine.unionByName(rest)


def fill_slots(rows: DataFrame, group: list[str]) -> DataFrame:
    """Keep a row's own slot if it is free, else take the lowest free one from 0 on, in encounter order.

    A group whose wanted slots all differ has nothing to move. For the others the rule is sequential by definition:
    their slim rows (group, src, pk, slot) stream through a task in order, whatever the size of the group; of a
    group only the slots in use above the lowest free one are held. ``rows`` has ``src, pk, Slot``; adds ``new_slot``.
    """
    sizes = rows.groupBy(*group).agg((F.count("*") <= F.count_distinct("Slot")).alias("_easy"))
    sized = materialize(rows.join(sizes, group), "slot-groups")
    easy = sized.where("_easy").withColumn("new_slot", F.col("Slot").cast("int")).drop("_easy")
    clash = sized.where("NOT _easy").drop("_easy")
    slim = clash.select(*group, "src", "pk", F.col("Slot").cast("int").alias("new_slot"))
    ordered = slim.repartition(*group).sortWithinPartitions(*group, "src", "pk")
    placed = ordered.mapInPandas(lambda batches: _place(batches, len(group)), slim.schema)
    return easy.unionByName(clash.join(placed, [*group, "src", "pk"]).select(*easy.columns))


def _place(batches: Iterator[pd.DataFrame], keys: int) -> Iterator[pd.DataFrame]:
    """The rule over a stream of rows sorted by group, src and pk; the last column is the wanted slot."""
    current, used, lowest = None, set(), 0
    for batch in batches:
        placed = []
        for key, slot in zip(zip(*[batch.iloc[:, i] for i in range(keys)]), batch.iloc[:, -1].tolist()):
            if key != current:
                current, used, lowest = key, set(), 0
            if slot in used or 0 <= slot < lowest:
                slot = lowest
            used.add(slot)
            while lowest in used:
                used.discard(lowest)
                lowest += 1
            placed.append(slot)
        yield batch.assign(new_slot=pd.Series(placed, index=batch.index, dtype="int32"))


def rename_collisions(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Later entities whose case-folded path is taken get a stable generated name.

    ``rows`` has ``[*scope, gid, Hash, FilePath]`` with ids in encounter order. Adds
    ``new_path`` and ``renamed``. The generated name counts up over equal (hash, path) and,
    should it ever equal a path in use, until it is free.
    """
    tagged = rows.withColumn("_path", path_key("FilePath"))
    first = tagged.groupBy(*scope, "_path").agg(F.min("gid").alias("_first"))
    marked = tagged.join(first, [*scope, "_path"]).withColumn("renamed", F.col("gid") != F.col("_first"))
    kept = marked.where("NOT renamed").withColumn("new_path", F.col("FilePath"))
    moved = ordinal_within(marked.where("renamed"), [*scope, "Hash", "FilePath"], ["gid"], "_n")
    moved = moved.withColumn("_n", F.col("_n") - 1)

    def named(df: DataFrame) -> DataFrame:
        seed = F.concat_ws("|", "Hash", "FilePath", F.col("_n").cast("string"))
        return df.withColumn("new_path", F.concat(stable_guid(seed), file_extension("FilePath")))

    moved = materialize(named(moved), "renamed-paths")
    taken = kept.select(*scope, F.col("_path").alias("_new"))
    clashes = moved.withColumn("_new", path_key("new_path")).join(taken, [*scope, "_new"], "left_semi").drop("_new")
    while not clashes.isEmpty():
        again = named(clashes.withColumn("_n", F.col("_n") + 1))
        moved = materialize(moved.join(clashes.select(*scope, "gid"), [*scope, "gid"], "left_anti").unionByName(again), "renamed-paths")
        clashes = moved.withColumn("_new", path_key("new_path")).join(taken, [*scope, "_new"], "left_semi").drop("_new")
    return kept.unionByName(moved.drop("_n")).drop("_path", "_first")
