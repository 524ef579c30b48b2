"""Manifest parsing, admission of files, media inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The manifest record and the names of special archive members.
MANIFEST_SCHEMA = (
    "name string, creationDate string, version double, type double, userDataBackup struct<"
    "lastModifiedDate string, deviceName string, databaseName string, hash string, schemaVersion string>"
)
MANIFEST_NAME = "manifest.json"
DATABASE_NAME = "userData.db"
THUMBNAIL_NAME = "default_thumbnail.png"
SIZE_CAP = 2 * 1024**3


def _string(text: Column, path: str) -> Column:
    """A JSON member as text, '' unless it is a JSON string."""
    value = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(text), path, "string")).otherwise(F.lit(""))


def _number(text: Column, path: str, default: int | None) -> Column:
    value = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(value)
    numeric = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")
    read = F.when(numeric, F.try_variant_get(F.try_parse_json(text), path, "double"))
    whole = F.when(numeric, F.coalesce(F.try_variant_get(F.try_parse_json(text), path, "int"), read.cast("int")))
    return whole if default is None else F.coalesce(whole, F.lit(default))


def parse_manifest(df: DataFrame, column: str) -> DataFrame:
    """Add the manifest fields with their defaults, and ``error`` (null when it is usable)."""
    text = F.col(column)
    parsed = F.try_parse_json(text)
    root = F.schema_of_variant(parsed)
    part = F.schema_of_variant(F.try_variant_get(parsed, "$.userDataBackup", "variant"))
    version = _number(text, "$.userDataBackup.schemaVersion", None)
    error = (
        F.when(parsed.isNull(), "not valid JSON")
        .when(~root.startswith("OBJECT") & ~root.startswith("ARRAY"), "not an object")
        .when(part.isNull() | ~(part.startswith("OBJECT") | part.startswith("ARRAY")), "no userDataBackup")
        .when(version.isNull(), "no numeric userDataBackup.schemaVersion")
    )
    database = _string(text, "$.userDataBackup.databaseName")
    fields = {
        "name": _string(text, "$.name"), "creationDate": _string(text, "$.creationDate"),
        "version": _number(text, "$.version", 1), "type": _number(text, "$.type", 0),
        "lastModifiedDate": _string(text, "$.userDataBackup.lastModifiedDate"),
        "deviceName": _string(text, "$.userDataBackup.deviceName"),
        "databaseName": F.when(database == "", DATABASE_NAME).otherwise(database),
        "hash": _string(text, "$.userDataBackup.hash"), "schemaVersion": version,
    }
    read = df.withColumn("error", error)
    return read.select("*", *[F.when(F.col("error").isNull(), c).alias(n) for n, c in fields.items()])


def admit_files(files: DataFrame, suffix: str, order: str, cap: int = SIZE_CAP) -> DataFrame:
    """Add ``rejection`` to offered files ``name, size``: null when a file is taken.

    Of equal (name, size) pairs that pass the other rules the first by ``order`` is taken; it is
    found by aggregation, so a name offered very often is no hot group.
    """
    basic = (
        F.when(~F.lower("name").endswith(suffix.lower()), "wrong suffix")
        .when(F.col("size") == 0, "empty").when(F.col("size") > cap, "too large")
    )
    judged = files.withColumn("_basic", basic)
    first = judged.where("_basic IS NULL").groupBy("name", "size").agg(F.min(order).alias("_first"))
    joined = judged.join(first, ["name", "size"], "left")
    again = F.when(F.col(order) != F.col("_first"), "already offered")
    return joined.withColumn("rejection", F.coalesce("_basic", again)).drop("_basic", "_first")


def media_inventory(members: DataFrame, keys: list[str]) -> DataFrame:
    """Root-level members that are media: neither manifest, database nor default thumbnail."""
    special = F.col("path").isin(MANIFEST_NAME, THUMBNAIL_NAME)
    if "databaseName" in members.columns:
        special = special | (F.col("path") == F.col("databaseName"))
    rows = members.where(~F.col("path").contains("/") & ~special)
    return rows.select(*keys, "path", F.length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))
