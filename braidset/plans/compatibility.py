"""Checks over the source registry: labels, compatibility, template, schema listing.

``sources`` has ``[*scope, src, FileName, DeviceName, SchemaVersion, MigrationId, UserVersion,
LastModified]`` and optionally ``MissingTables`` / ``MissingColumns`` (arrays of text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from braidset import schema
from braidset.functions.text import full_trim
from braidset.functions.timestamps import latest_text


def migration_number(c) -> F.Column:
    """Trailing digits of a migration id, -1 when there are none."""
    digits = F.regexp_extract(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(\d+)\s*$", 1)
    return F.when(digits == "", F.lit(-1).cast("bigint")).otherwise(digits.cast("bigint"))


def reindex_sources(sources: DataFrame, scope: list[str], upload: str) -> DataFrame:
    """Dense source ordinals from 0 in upload order (the sources of one owner are few)."""
    window = Window.partitionBy(*scope).orderBy(upload)
    return sources.withColumn("src", F.row_number().over(window) - 1)


def label_sources(sources: DataFrame, scope: list[str]) -> DataFrame:
    """Add ``label``: trimmed device, else file, else a numbered name; repeats are numbered."""
    device = F.nullif(F.coalesce(full_trim("DeviceName"), F.lit("")), F.lit(""))
    base = F.coalesce(device, F.nullif("FileName", F.lit("")), F.concat(F.lit("Backup "), F.col("src") + 1))
    nth = F.row_number().over(Window.partitionBy(*scope, "_base").orderBy("src"))
    numbered = sources.withColumn("_base", base).withColumn("_n", nth)
    label = F.when(F.col("_n") == 1, F.col("_base")).otherwise(
        F.concat(F.col("_base"), F.lit(" ("), F.col("_n"), F.lit(")"))
    )
    return numbered.withColumn("label", label).drop("_base", "_n")


def expected_columns(spark: SparkSession) -> DataFrame:
    """The registry as rows (table, column); column is null for tables checked by name only."""
    rows = [(t, c) for t in schema.TABLES for c in schema.columns(t)] + [(t, None) for t in schema.SYSTEM_TABLES]
    return spark.createDataFrame(rows, "table string, column string")


def check_schema(listing: DataFrame, keys: list[str]) -> DataFrame:
    """Missing tables and columns per source from a listing ``[*keys, table, column]``."""
    expected = expected_columns(listing.sparkSession)
    sources = listing.select(*keys).distinct()
    tables = expected.select("table").distinct()
    wanted = sources.select(*keys, F.explode(F.array(*[F.lit(t) for t in (*schema.TABLES, *schema.SYSTEM_TABLES)])).alias("table"))
    have = listing.select(*keys, "table").distinct()
    gone = wanted.join(have, [*keys, "table"], "left_anti").groupBy(*keys).agg(
        F.array_sort(F.collect_list("table")).alias("MissingTables")
    )
    needed = have.join(F.broadcast(expected.where("column IS NOT NULL")), "table")
    lacking = needed.join(listing, [*keys, "table", "column"], "left_anti").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.concat_ws(".", "table", "column"))).alias("MissingColumns")
    )
    empty = F.array().cast("array<string>")
    return (
        sources.join(gone, keys, "left").join(lacking, keys, "left")
        .withColumn("MissingTables", F.coalesce("MissingTables", empty))
        .withColumn("MissingColumns", F.coalesce("MissingColumns", empty))
        .withColumn("ok", (F.size("MissingTables") == 0) & (F.size("MissingColumns") == 0))
    )


def schema_objects(listing: DataFrame, keys: list[str]) -> DataFrame:
    """Number of tables, indexes and triggers per source from ``[*keys, type, name, sql]``."""
    own = listing.where("sql IS NOT NULL AND name NOT LIKE 'sqlite\\\\_%' AND type IN ('table', 'index', 'trigger')")
    counts = [F.count(F.when(F.col("type") == t, 1)).alias(n) for t, n in
              (("table", "tables"), ("index", "indexes"), ("trigger", "triggers"))]
    return own.groupBy(*keys).agg(*counts)


def table_exists(listing: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Sources that hold a table."""
    return listing.where(F.col("table") == table).select(*keys).distinct()


def elect_template(sources: DataFrame, scope: list[str]) -> DataFrame:
    """Source with the highest migration number, the first one on a tie."""
    best = F.max_by("src", F.struct(migration_number("MigrationId"), -F.col("src")))
    return sources.groupBy(*scope).agg(best.alias("template_src"))


def check_compatibility(sources: DataFrame, scope: list[str]) -> DataFrame:
    """One row per scope: errors, warnings, common version, template source."""
    labelled = label_sources(sources, scope)
    if "MissingTables" in sources.columns:
        missing = F.concat("MissingTables", "MissingColumns")
    else:
        missing = F.array().cast("array<string>")
    listed = F.concat_ws(", ", F.slice(missing, 1, 6))
    shortage = F.when(
        F.size(missing) > 0,
        F.concat(F.col("label"), F.lit(": missing tables or columns ("), listed,
                 F.when(F.size(missing) > 6, ", …").otherwise(""), F.lit(")")),
    )
    in_order = lambda text: F.transform(
        F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("src", text.alias("t"))))), lambda x: x["t"]
    )
    version = F.concat_ws(" = ", "label", F.col("SchemaVersion").cast("string"))
    migration = F.concat_ws(" = ", "label", F.coalesce(F.nullif("MigrationId", F.lit("")), F.lit("?")))
    report = labelled.groupBy(*scope).agg(
        F.count("*").alias("n_sources"),
        F.count_distinct("SchemaVersion").alias("n_versions"),
        F.count_distinct(F.coalesce("MigrationId", F.lit(""))).alias("n_migrations"),
        F.min("SchemaVersion").alias("_version"),
        in_order(version).alias("_versions"),
        in_order(shortage).alias("_shortages"),
        in_order(migration).alias("_migrations"),
        F.max_by("src", F.struct(migration_number("MigrationId"), -F.col("src"))).alias("template_src"),
        F.max_by("MigrationId", F.struct(migration_number("MigrationId"), -F.col("src"))).alias("migration_id"),
        F.max_by("UserVersion", F.struct(migration_number("MigrationId"), -F.col("src"))).alias("_user_version"),
        latest_text("LastModified", "src").alias("latest_last_modified"),
    )
    none = F.array().cast("array<string>")
    clash = F.concat(F.lit("schema versions differ: "), F.array_join("_versions", ", "))
    errors = F.concat(
        F.when(F.col("n_sources") == 0, F.array(F.lit("no sources were given")))
        .when(F.col("n_versions") > 1, F.array(clash)).otherwise(none),
        F.coalesce("_shortages", none),
    )
    levels = F.concat(F.lit("migration levels differ: "), F.array_join("_migrations", ", "))
    return report.select(
        *scope,
        (F.size(errors) == 0).alias("ok"),
        errors.alias("errors"),
        F.when(F.col("n_migrations") > 1, F.array(levels)).otherwise(none).alias("warnings"),
        F.when(F.col("n_versions") == 1, F.col("_version")).alias("schema_version"),
        "template_src",
        "migration_id",
        F.coalesce(F.nullif("_user_version", F.lit(0)), F.when(F.col("n_versions") == 1, F.col("_version"))).alias("user_version"),
        "latest_last_modified",
        "n_sources",
    )
