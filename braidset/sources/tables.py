"""Typed table scans and the write/read of a merged snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from braidset import schema
from braidset.functions.hashing import sha256_hex
from braidset.functions.text import full_trim
from braidset.functions.timestamps import format_utc, iso_local, offset_form
from braidset.plans.compatibility import migration_number


def scan_table(spark: SparkSession, path: str, table: str, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Parquet scan with the fixed schema of a table; only its columns are read."""
    fields = [f"{name} {kind}" for name, kind in keys]
    ddl = ", ".join([*fields, schema.COLUMNS[table]])
    return spark.read.schema(ddl).parquet(path)


def project(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Key columns followed by the registry columns in their order."""
    return df.select(*keys, *schema.columns(table))


def scan_source_meta(last_modified: DataFrame, migrations: DataFrame, keys: list[str]) -> DataFrame:
    """Last-modified text ('' if none) and the highest-numbered migration id ('' if none) per source."""
    stamp = last_modified.groupBy(*keys).agg(F.first("LastModified", ignorenulls=True).alias("LastModified"))
    level = migrations.groupBy(*keys).agg(F.max_by("identifier", migration_number("identifier")).alias("MigrationId"))
    return stamp.join(level, keys, "full_outer").fillna("", ["LastModified", "MigrationId"])


def write_snapshot(tables: dict[str, DataFrame], path: str, scope: list[str]) -> None:
    """Write every table, parents first, range-partitioned and sorted by scope and primary key."""
    for table in schema.TABLES:
        order = [*scope, *schema.primary_key(table)]
        rows = project(tables[table], table, scope).repartitionByRange(*order).sortWithinPartitions(*order)
        try:
            rows.write.parquet(f"{path}/{table}")
        except Exception as error:
            raise RuntimeError(f"writing table {table} failed: {error}") from error


def read_snapshot(spark: SparkSession, path: str, scope: list[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    return {table: scan_table(spark, f"{path}/{table}", table, scope) for table in schema.TABLES}


def default_device_name(n_sources) -> F.Column:
    n = F.col(n_sources) if isinstance(n_sources, str) else n_sources
    return F.concat(F.lit("Merged ("), n, F.when(n == 1, F.lit(" backup)")).otherwise(F.lit(" backups)")))


def default_file_name(now_ms, suffix: str) -> F.Column:
    now = F.col(now_ms) if isinstance(now_ms, str) else now_ms
    day = F.date_format(F.timestamp_millis(now), "yyyy-MM-dd")
    return F.concat(F.lit("UserdataBackup_"), day, F.lit("_Merged" + suffix))


def or_default(given, default: F.Column) -> F.Column:
    """Trimmed input, or the default when it is blank."""
    text = F.coalesce(full_trim(given), F.lit(""))
    return F.when(text == "", default).otherwise(text)


def build_manifest(compatibility: DataFrame, digests: DataFrame, scope: list[str], now_ms: int, suffix: str = ".zip",
                   device: str = "", file_name: str = "") -> DataFrame:
    """Manifest record per scope: ``[*scope, manifest]`` as JSON.

    ``digests`` is ``fingerprint`` output of the tables as written; the manifest hash covers it,
    and is never taken from a source.
    """
    now = F.lit(now_ms).cast("bigint")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "table", F.col("n").cast("string"), "digest"))), "\n")
    total = digests.groupBy(*scope).agg(sha256_hex(lines).alias("hash"))
    one = scope or ["_one"]
    if not scope:
        total, compatibility = total.withColumn("_one", F.lit(1)), compatibility.withColumn("_one", F.lit(1))
    joined = compatibility.join(total, one, "left")
    record = F.struct(
        or_default(F.lit(file_name), default_file_name(now, suffix)).alias("name"),
        iso_local(now).alias("creationDate"), F.lit(1).alias("version"), F.lit(0).alias("type"),
        F.struct(
            offset_form(format_utc(now)).alias("lastModifiedDate"),
            or_default(F.lit(device), default_device_name("n_sources")).alias("deviceName"),
            F.lit("userData.db").alias("databaseName"),
            F.coalesce("hash", sha256_hex(F.lit(""))).alias("hash"), F.col("schema_version").alias("schemaVersion"),
        ).alias("userDataBackup"),
    )
    return joined.select(*scope, F.to_json(record).alias("manifest"))


def collect_media(collected: DataFrame, media_files: DataFrame, scope: list[str]) -> DataFrame:
    """Bytes of every merged media path from the source that holds them: ``[*scope, FilePath, content]``."""
    return collected.join(media_files, [*scope, "src", "path"]).select(*scope, "FilePath", "content")


def output_members(collected: DataFrame, scope: list[str], removed: DataFrame | None = None) -> DataFrame:
    """Media members of the output by name, without files of removed media rows."""
    kept = collected if removed is None else collected.join(removed, [*scope, "FilePath"], "left_anti")
    return kept.select(*scope, "FilePath").orderBy(*scope, "FilePath")


def pick_thumbnail(thumbnails: DataFrame, scope: list[str]) -> DataFrame:
    """Default thumbnail of the first source that has one."""
    return thumbnails.where("content IS NOT NULL").groupBy(*scope).agg(F.min_by("content", "src").alias("content"))
