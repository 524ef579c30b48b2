"""Checked, atomic writing of a result, and the proof that what was written is what is read.

A version of a result is a folder of table folders. Every table is written once; row rules, rows and digests are observed while
it is written, so that no further pass is needed for a sound table. Unique keys and references are checked on what was written. Rows that
break a rule are listed by table, rule and key. A version counts only once its marker exists, which is created in one step and never
overwritten; the marker holds the folder, row count and digest of each table, and readers start from it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from braidset import schema
from braidset.functions import keys as K
from braidset.session import MadeOnUse, materialize
from braidset.sources.tables import project, scan_table

_MARKERS = "_published"


class SnapshotRejected(ValueError):
    """Raised when rows of a result break a rule; nothing is published.

    ``rejects`` is the DataFrame of all such rows (see ``publish``); the message names the first table and rule.
    """

    def __init__(self, rejects: DataFrame) -> None:
        order = F.create_map(*[F.lit(x) for i, t in enumerate(schema.TABLES) for x in (t, i)])
        first = rejects.groupBy("table", "rule").agg(F.count("*").alias("n")).orderBy(order[F.col("table")], "rule").first()
        super().__init__(f"writing table {first['table']} failed: {first['n']} row(s) break the rule '{first['rule']}'")
        self.rejects = rejects


def row_rules(table: str) -> list[tuple[str, Column]]:
    """(name, condition that a row breaks) of the row rules and of the columns that must be set."""
    rules = [(name, F.expr(f"NOT coalesce({rule}, true)")) for t, name, rule in schema.ROW_RULES if t == table]
    return rules + [(f"{c} is set", F.col(c).isNull()) for c in schema.not_null_columns(table)]


def digests(columns: list[str]) -> list[Column]:
    """Order-independent digest of rows: two exact sums of independent 64-bit row hashes."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(K.NULL_TOKEN)) for c in columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")) for seed in (1, 2)]
    return [F.coalesce(s, F.lit(0)).cast("string").alias(f"digest{i}") for i, s in enumerate(sums)]


def _write_observed(rows: DataFrame, table: str, folder: str, scope: list[str]) -> dict:
    """Write a table sorted by key; its row count, digests and number of rows that break a row rule come with the write."""
    order = [*scope, *schema.primary_key(table)]
    broken = reduce(lambda a, b: a | b, [c for _, c in row_rules(table)])
    seen = Observation()
    # Observed behind the exchange: the rows before it are also read for the ranges.
    ranged = project(rows, table, scope).repartitionByRange(*order).sortWithinPartitions(*order)
    counted = ranged.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(broken, 1)).alias("broken"), *digests([*scope, *schema.columns(table)]))
    counted.write.mode("overwrite").parquet(folder, compression="zstd")
    return seen.get


def _row_rejects(rows: DataFrame, table: str, scope: list[str]) -> DataFrame:
    names = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in row_rules(table)]), lambda n: n.isNotNull())
    return rows.withColumn("rule", F.explode(names))


def _repeat_rejects(rows: DataFrame, table: str, scope: list[str]) -> DataFrame | None:
    """All rows but the first by key of those that are equal in a unique constraint; keys with a null part never are."""
    constraints = [("primary key", schema.primary_key(table))] + [(n, e) for t, n, e in schema.UNIQUE_KEYS if t == table]
    parts = []
    for name, exprs in constraints:
        names = [f"_k{i}" for i in range(len(exprs))]
        slim = rows.select(*scope, *schema.primary_key(table), "_row", *[F.expr(e).alias(n) for e, n in zip(exprs, names)]).dropna(subset=names)
        first = slim.groupBy(*scope, *names).agg(F.count("*").alias("_n"), F.min(F.struct(*schema.primary_key(table), "_row")).alias("_first")).where("_n > 1")
        later = slim.join(first, [*scope, *names]).where(F.col("_row") != F.col("_first._row"))
        parts.append(later.select(*scope, "_row", F.lit(f"unique {name}").alias("rule")))
    return reduce(DataFrame.unionByName, parts)


def _dangling_rejects(rows: DataFrame, table: str, accepted: Mapping[str, DataFrame], scope: list[str]) -> list[DataFrame]:
    parts = []
    for child, column, parent, key in schema.FOREIGN_KEYS:
        if child == table:
            known = accepted[parent].select(*scope, F.col(key).alias(column)).distinct()
            lost = rows.where(F.col(column).isNotNull()).join(known, [*scope, column], "left_anti")
            parts.append(lost.withColumn("rule", F.lit(f"{column} refers to {parent}")))
    return parts


def find_rejects(tables: Mapping[str, DataFrame], scope: list[str]) -> tuple[DataFrame, Mapping[str, DataFrame]]:
    """(rejects, accepted): offending rows as ``[*scope, table, rule, row_key]``, and the tables without them.

    Parents come first, so a row whose parent is rejected is rejected with it. A row that breaks several rules has a line for
    each. Of rows with equal unique keys the first by primary key is accepted.
    """
    accepted = _Accepted(tables, scope)
    rejects = []
    for table in schema.TABLES:
        rows, own = accepted.judged(table)
        named = rows.join(own.select("_row", "rule"), "_row")
        rejects.append(named.select(*scope, F.lit(table).alias("table"), "rule", K.local_key(table).alias("row_key")))
    return reduce(DataFrame.unionByName, rejects), accepted


def accepted_rows(tables: Mapping[str, DataFrame], scope: list[str]) -> Mapping[str, DataFrame]:
    """The accepted tables of ``find_rejects``; each is judged, after its parents, when it is first asked for."""
    return _Accepted(tables, scope)


class _Accepted(MadeOnUse):
    def __init__(self, tables: Mapping[str, DataFrame], scope: list[str]) -> None:
        super().__init__(schema.TABLES, self._accept)
        self._tables, self._scope, self._judged = tables, scope, {}

    def judged(self, table: str) -> tuple[DataFrame, DataFrame]:
        """Rows of a table with ``_row``, and one line for each rule that one of them breaks."""
        if table not in self._judged:
            rows = _told_apart(self._tables[table], table, self._scope)
            own = reduce(DataFrame.unionByName, [d.select(*self._scope, "_row", "rule") for d in (
                _row_rejects(rows, table, self._scope), _repeat_rejects(rows, table, self._scope), *_dangling_rejects(rows, table, self, self._scope))])
            self._judged[table] = rows, materialize(own, f"rejected-{table}")
        return self._judged[table]

    def _accept(self, table: str) -> DataFrame:
        rows, own = self.judged(table)
        return rows.join(own.select("_row").distinct(), "_row", "left_anti").drop("_row")


def _told_apart(df: DataFrame, table: str, scope: list[str]) -> DataFrame:
    """Rows of a table with ``_row``, which tells them apart; other tables than stage tables are written for that."""
    if hasattr(df, "stage_path"):
        # Rows of a written table are known by their file and their place in it, so there is no need of a copy.
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        return df.select(*scope, *schema.columns(table), place.alias("_row"))
    return materialize(project(df, table, scope).withColumn("_row", F.monotonically_increasing_id()), f"checked-{table}")


def publish(tables: dict[str, DataFrame], root: str, version: int, scope: list[str], split: bool = False) -> DataFrame | None:
    """Write ``tables`` as a version under ``root`` and publish it; rows that break a rule stop it, or are split off with ``split``.

    Returns None if no row breaks a rule. Otherwise the offending rows (``[*scope, table, rule, row_key]``) are written to
    ``_rejected`` beside the tables; they are the return value with ``split``, else ``SnapshotRejected`` is raised
    and no marker is set. A version that is published already is left as it is (None).
    """
    spark = tables["Location"].sparkSession
    if version in published(spark, root):
        return None
    folder = f"{root}/version={version}"
    seen = {t: _write_observed(tables[t], t, f"{folder}/{t}", scope) for t in schema.TABLES}
    keys = [(c, tables["Location"].schema[c].dataType.simpleString()) for c in scope]
    written = {t: scan_table(spark, f"{folder}/{t}", t, keys) for t in schema.TABLES}
    for table, df in written.items():
        df.stage_path = f"{folder}/{table}"
    folders = {t: f"version={version}/{t}" for t in schema.TABLES}
    rejects = None
    if any(s["broken"] for s in seen.values()) or not _keys_hold(written, scope):
        found, accepted = find_rejects(written, scope)
        found.write.mode("overwrite").parquet(f"{folder}/_rejected")
        rejects = spark.read.schema(found.schema).parquet(f"{folder}/_rejected")
        if not split:
            raise SnapshotRejected(rejects)
        for table in [r["table"] for r in rejects.select("table").distinct().collect()]:
            folders[table] = f"version={version}/{table}-accepted"
            seen[table] = _write_observed(accepted[table], table, f"{root}/{folders[table]}", scope)
    _mark(spark, root, version, {t: {"folder": folders[t], **{k: seen[t][k] for k in ("rows", "digest0", "digest1")}} for t in schema.TABLES})
    return rejects


def _keys_hold(tables: dict[str, DataFrame], scope: list[str]) -> bool:
    """Whether no unique key repeats and no reference dangles, from counts alone."""
    from braidset.plans.validate import fk_violations, unique_violations

    return all(check(tables, scope).where("violations > 0").isEmpty() for check in (unique_violations, fk_violations))


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _mark(spark: SparkSession, root: str, version: int, tables: dict) -> None:
    fs, at = _file(spark, f"{root}/{_MARKERS}/{version}")
    out = fs.create(at, False)  # fails if the marker exists
    try:
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
    finally:
        out.close()


def published(spark: SparkSession, root: str) -> list[int]:
    """Published versions, ascending."""
    fs, at = _file(spark, f"{root}/{_MARKERS}")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def marker(spark: SparkSession, root: str, version: int) -> dict:
    """Folder, rows and digests of each table of a published version."""
    line = spark.read.text(f"{root}/{_MARKERS}/{version}", wholetext=True).first()
    return json.loads(line["value"])


def read_published(spark: SparkSession, root: str, version: int, scope: list[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    return {t: scan_table(spark, f"{root}/{m['folder']}", t, scope) for t, m in marker(spark, root, version).items()}


def prove_published(spark: SparkSession, root: str, version: int, scope: list[tuple[str, str]] = (),
                    expected: dict[str, int] | None = None) -> DataFrame:
    """What was written against what is read back: one line per table.

    ``table, expected, final`` (rows), ``same`` (as many rows), ``contents`` (equal digests, so not a cell has changed), ``dangling``
    (references of the table to no row, as read back). ``expected`` row counts take the place of those of the write.
    A folder that is gone reads as an empty table.
    """
    from braidset.plans.validate import fk_violations

    notes, tables, keys = marker(spark, root, version), {}, [c for c, _ in scope]
    for table, note in notes.items():
        fs, at = _file(spark, f"{root}/{note['folder']}")
        if fs.exists(at):
            tables[table] = scan_table(spark, f"{root}/{note['folder']}", table, scope)
        else:
            kinds = ", ".join([*(f"{n} {k}" for n, k in scope), schema.COLUMNS[table]])
            tables[table] = spark.createDataFrame([], kinds)
    read = reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("final"), *digests([*keys, *schema.columns(t)])).withColumn("table", F.lit(t)) for t, df in tables.items()])
    wrote = spark.createDataFrame(
        [(t, int((expected or {}).get(t, n["rows"])), n["digest0"], n["digest1"]) for t, n in notes.items()],
        "table string, expected long, _a string, _b string")
    lost = fk_violations(tables, keys).groupBy("table").agg(F.sum("violations").alias("dangling"))
    both = wrote.join(read, "table").join(lost, "table", "left")
    return both.select(
        "table", "expected", "final", (F.col("expected") == F.col("final")).alias("same"),
        ((F.col("_a") == F.col("digest0")) & (F.col("_b") == F.col("digest1"))).alias("contents"), F.coalesce("dangling", F.lit(0)).cast("long").alias("dangling"))
