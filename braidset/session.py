"""Stage tables in the cluster's shared folder, and the session settings we rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
#: Deletes the shuffle files of a query when it ends.
_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
#: Bytes of a file or shuffle up to which a side of a join is broadcast while a stage table is written. Both are compressed: their
#: rows take tens of times as much in the driver, and a query holds dozens of them.
_SMALL = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="braidset-")
    return _local_dirs[app]


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a stage result once as a table and continue from the table.

    The written table survives lost executors, freezes values that are not reproducible (partition-based numbering) and ends the
    lineage of the stage. The shuffle files of the job that wrote it are no longer needed and go with its end. Only small sides of
    joins are broadcast for it.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/braidset/{app}/{name}-{uuid.uuid4().hex}"
    limit = min(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold(), _SMALL)
    held = {_LET_GO: "true", _BROADCAST: str(limit)}
    before = {name: spark.conf.get(name, None) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    table = spark.read.schema(df.schema).parquet(path)
    table.stage_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that ``materialize`` wrote and that no later result reads; other frames are left alone."""
    for table in tables:
        path = getattr(table, "stage_path", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class MadeOnUse(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, names: Iterable[str], make: Callable[[str], DataFrame]) -> None:
        self._names, self._make, self._made = tuple(names), make, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._names

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Session settings the operators are designed for; sizes are left to the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
