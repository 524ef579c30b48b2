"""Shared parts of the text operators: running sums, connected components, labelled samples."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from braidset.operators.components import components  # noqa: F401  (used by the operators of this package)
from braidset.session import materialize


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this worker process keeps between the tasks of an operator: its module, and how to let it go.
_kept: dict[str, Callable[[], object]] = {}


def keep_between_tasks(operator: str, let_go: Callable[[], object]) -> None:
    """Called in a worker whose operator keeps something there; ``let_go`` is called when another operator's work begins."""
    _kept[operator] = let_go


def let_others_go(operator: str) -> None:
    """Let go what operators other than this one keep in this worker."""
    for other in [o for o in _kept if o != operator]:
        _kept.pop(other)()


def tidied(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, after which the Python worker gives its freed memory back to the system.

    Workers stay alive between tasks, and what the allocators keep would count beside the next stage's memory. What another
    operator keeps in the worker goes first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_others_go(work.__module__)
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
            if trim is not None:
                trim(0)

    return run


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and with this one, in the given order.

    The table is range-partitioned by group and order, so that a hot group is many
    partitions; each partition sums its own rows and starts from one carried sum per
    (group, partition). Rows equal in all of ``order`` come in any order.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("_rs_part", F.spark_partition_id())
    fixed = materialize(ranged, "running")
    carry = fixed.groupBy(*group, "_rs_part").agg(F.sum(value).alias("_rs_sum"))
    before = Window.partitionBy(*group).orderBy("_rs_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*group, "_rs_part", F.coalesce(F.sum("_rs_sum").over(before), F.lit(0)).alias("_rs_before"))
    local = Window.partitionBy(*group, "_rs_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        fixed.withColumn("_rs_local", F.sum(value).over(local))
        .join(carry, [*group, "_rs_part"])
        .withColumn(out, F.col("_rs_before") + F.col("_rs_local"))
        .drop("_rs_before", "_rs_local", "_rs_part")
    )


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns and group starts of a partition sorted by its first ``keys`` (long) columns, no group cut in two.

    Holds one batch and the group that it ends in, so groups must be bounded. Starts end with the number of rows.
    """
    held: pa.RecordBatch | None = None
    for batch in _and_none(batches):
        if batch is not None and not batch.num_rows:
            continue
        if held is not None and batch is not None:
            table = pa.Table.from_batches([held, batch]).combine_chunks()
            batch = table.to_batches(max_chunksize=table.num_rows)[0]
        elif batch is None:
            batch, held = held, None
            if batch is None:
                return
            yield _columns(batch), _starts(batch, keys)
            return
        starts = _starts(batch, keys)
        last = int(starts[-2])
        held = batch.slice(last)
        if last:
            done = batch.slice(0, last)
            yield _columns(done), starts[:-1]


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    changed = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in range(keys):
        changed |= np.diff(batch.column(k).to_numpy(zero_copy_only=False)) != 0
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [batch.num_rows]])


def dealt(df: DataFrame, keys: list[str], by: Column, size: int) -> DataFrame:
    """``df`` with ``blocks``, the number of blocks of its key, and ``block``, its own, dealt by a hash of ``by``.

    A block has about ``size`` rows at most. Only keys with more rows than that are listed, in a table whose size Spark knows
    when it plans the join.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    crowded = materialize(counts.select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("blocks")), "crowded")
    joined = df.join(crowded, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return joined.withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))


def paired_blocks() -> Column:
    """Of a row of ``dealt``, the groups (rb, vb, role) that it goes to, so that every two blocks of a key meet in one group.

    Role 0 is the left side, 1 the right side, 2 both (in a key that is one block).
    """
    place = lambda rb, vb, role: F.struct(rb.cast("int").alias("rb"), vb.cast("int").alias("vb"), F.lit(role).alias("role"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    both = F.concat(F.transform(every, lambda v: place(F.col("block"), v, 0)), F.transform(every, lambda r: place(r, F.col("block"), 1)))
    return F.explode(F.when(F.col("blocks") == 1, F.array(place(F.lit(0), F.lit(0), 2))).otherwise(both))
