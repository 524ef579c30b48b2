"""Scan of a fleet of snapshot archives: zip files holding a manifest, a database and media.

Archives are independent, so each is opened inside a task and turned into rows; a broken
archive becomes an error row, never a failed job. The rows of all archives come out in one
long form and are split into typed tables by Spark. Rows leave a task in bounded batches.
"""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from braidset import schema
from braidset.plans.compatibility import check_schema
from braidset.session import materialize
from braidset.sources.manifest import MANIFEST_NAME, parse_manifest
from braidset.sources.tables import scan_source_meta

# kind: manifest, error, row, object, column, stamp, migration, version, member
_LONG = "path string, kind string, name string, body string, content binary"
# Rows, and bytes of media and text, that leave a task at once.
_BATCH, _BATCH_BYTES = 2000, 8 << 20


def read_members(spark: SparkSession, glob: str) -> DataFrame:
    """Everything the archives hold, in long form; a task opens one archive after the other."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInPandas(_open_all, _LONG)


def _open_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            pending, size = [], 0
            for record in _safe(content):
                pending.append((path, *record))
                size += sum(len(x) for x in record if x is not None)
                if len(pending) >= _BATCH or size >= _BATCH_BYTES:
                    yield pd.DataFrame(pending, columns=["path", "kind", "name", "body", "content"])
                    pending, size = [], 0
            if pending:
                yield pd.DataFrame(pending, columns=["path", "kind", "name", "body", "content"])


def _safe(content: bytes) -> Iterator[tuple]:
    try:
        yield from _open(content)
    except Exception as error:  # whatever is wrong with one archive, it is one error row
        yield ("error", None, f"{type(error).__name__}: {error}", None)


def _find(archive: zipfile.ZipFile, wanted: str) -> str | None:
    """Root-level member by name; letter case is forgiven, folders are not."""
    names = [i.filename for i in archive.infolist() if not i.is_dir()]
    if wanted in names:
        return wanted
    return next((n for n in names if "/" not in n and n.lower() == wanted.lower()), None)


def _open(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        manifest_name = _find(archive, MANIFEST_NAME)
        if manifest_name is None:
            raise KeyError("the archive has no manifest")
        manifest = archive.read(manifest_name).decode("utf-8", "replace")
        record = json.loads(manifest)
        part = record.get("userDataBackup") if isinstance(record, dict) else None
        named = part.get("databaseName") if isinstance(part, dict) else None
        wanted = named if isinstance(named, str) and named else "userData.db"
        database = _find(archive, wanted)
        if database is None:
            raise KeyError(f"the archive has no database {wanted}")
        # The rows come first: a database that cannot be read leaves nothing but its error.
        yield from _read_database(archive.read(database))
        yield ("manifest", None, manifest, None)
        for info in archive.infolist():
            name = info.filename
            if not info.is_dir() and "/" not in name and name not in (manifest_name, database):
                yield ("member", name, None, archive.read(name))


def _plain(value: object) -> object:
    """A stored value as JSON can hold it; bytes in a text column are read as text."""
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else value


def _read_database(content: bytes) -> Iterator[tuple]:
    connection = sqlite3.connect(":memory:")
    try:
        connection.deserialize(content)
        objects = connection.execute("SELECT type, name, sql FROM sqlite_master").fetchall()
        for kind, name, sql in objects:
            yield ("object", kind, json.dumps({"name": name, "sql": sql}), None)
        held = {name for kind, name, _ in objects if kind == "table"}
        columns = {t: [c[1] for c in connection.execute(f'PRAGMA table_info("{t}")')] for t in held}
        for table, names in columns.items():
            for name in names:
                yield ("column", table, name, None)
        yield ("version", None, str(connection.execute("PRAGMA user_version").fetchone()[0]), None)
        if "LastModified" in held:
            for (value,) in connection.execute("SELECT LastModified FROM LastModified LIMIT 1"):
                yield ("stamp", None, _plain(value), None)
        if "grdb_migrations" in held:
            for (value,) in connection.execute("SELECT identifier FROM grdb_migrations"):
                yield ("migration", None, _plain(value), None)
        for table in schema.TABLES:
            wanted = schema.columns(table)
            if table in held and set(wanted) <= set(columns[table]):
                listed = ", ".join(f'"{c}"' for c in wanted)
                for values in connection.execute(f'SELECT {listed} FROM "{table}"'):
                    yield ("row", table, json.dumps({c: _plain(v) for c, v in zip(wanted, values)}), None)
    finally:
        connection.close()


def read_archives(spark: SparkSession, glob: str) -> dict:
    """Snapshots of all archives matching ``glob``.

    Returns ``tables`` (per entity table), ``sources``, ``media_files``, ``thumbnails``,
    ``objects``, ``schema`` and ``errors``. Sources are numbered by path. A source that fails
    the schema check is listed but contributes no rows.
    """
    long = materialize(read_members(spark, glob), "archives")
    errors = long.where("kind = 'error'").select("path", F.col("body").alias("error"))
    readable = long.join(errors, "path", "left_anti")
    manifests = parse_manifest(readable.where("kind = 'manifest'").select("path", "body"), "body")
    bad = manifests.where("error IS NOT NULL").select("path", "error")
    listing = readable.where("kind = 'column'").select("path", F.col("name").alias("table"), F.col("body").alias("column"))
    checked = check_schema(listing, ["path"])
    meta = scan_source_meta(
        readable.where("kind = 'stamp'").select("path", F.col("body").alias("LastModified")),
        readable.where("kind = 'migration'").select("path", F.col("body").alias("identifier")), ["path"],
    )
    versions = readable.where("kind = 'version'").select("path", F.col("body").cast("int").alias("UserVersion"))
    file_name = F.element_at(F.split("path", "/"), -1)
    registry = (
        manifests.where("error IS NULL").join(checked, "path", "left").join(meta, "path", "left").join(versions, "path", "left")
        .select(
            "path", file_name.alias("FileName"), F.coalesce(F.nullif("deviceName", F.lit("")), file_name).alias("DeviceName"),
            F.col("schemaVersion").alias("SchemaVersion"), F.coalesce("MigrationId", F.lit("")).alias("MigrationId"),
            F.coalesce("UserVersion", F.lit(0)).alias("UserVersion"), F.coalesce("LastModified", F.lit("")).alias("LastModified"),
            "MissingTables", "MissingColumns", "ok", "databaseName",
        )
    )
    from braidset.operators.ordinals import global_ordinal

    sources = global_ordinal(registry, ["path"], "_n").withColumn("src", (F.col("_n") - 1).cast("int")).drop("_n")
    sources = materialize(sources, "registry")
    numbered = sources.select("path", "src", "ok", "databaseName")
    rows = readable.where("kind = 'row'").join(numbered.where("ok"), "path")
    tables = {
        t: rows.where(F.col("name") == t).select("src", F.from_json("body", schema.struct_type(t)).alias("r")).select("src", "r.*")
        for t in schema.TABLES
    }
    members = readable.where("kind = 'member'").join(numbered, "path").select("src", F.col("name").alias("path"), "content", "databaseName")
    thumbnail = F.col("path") == "default_thumbnail.png"
    objects = readable.where("kind = 'object'").join(numbered, "path").select(
        "src", F.col("name").alias("type"), F.get_json_object("body", "$.name").alias("name"), F.get_json_object("body", "$.sql").alias("sql")
    )
    return {
        "tables": tables, "sources": sources.drop("databaseName"),
        "media_files": members.where(~thumbnail).select("src", "path", "content"),
        "thumbnails": members.where(thumbnail).select("src", "content"),
        "objects": objects, "schema": checked, "errors": errors.unionByName(bad),
    }
