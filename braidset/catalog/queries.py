"""Registered queries: name -> function of (spark, sf_dir).

All of them read whole given tables, mostly as the three snapshots of ``derive``. The
analysis of a snapshot set is computed once per session and input folder, stage by stage
as queries ask for it, and its stage tables are shared by the queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from braidset import schema
from braidset.catalog import derive
from braidset.functions import hashing, keys as K, text as X, timestamps as TS
from braidset.operators.conflicts import mark_identical, update_resolutions
from braidset.plans import cleanup, compatibility, finalize as fin, health, report, validate
from braidset.plans.analyze import Analysis
from braidset.session import MadeOnUse, shared_dir
from braidset.sources import manifest, publish as gate, tables as io
from braidset.streaming.increment import merge_late

_shared: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return _once(spark, sf_dir, "analysis", lambda: Analysis(
        derive.snapshot_tables(spark, sf_dir), derive.derived(spark, sf_dir, "sources"), [], derive.media_files(spark, sf_dir)
    ))


def _tangled(spark: SparkSession, sf_dir: str) -> Analysis:
    return _once(spark, sf_dir, "tangled", lambda: Analysis(
        {"Location": derive.derived(spark, sf_dir, "Location", tangled=True)}, derive.derived(spark, sf_dir, "sources")
    ))


def _default(spark: SparkSession, sf_dir: str) -> fin.Result:
    return _once(spark, sf_dir, "default", lambda: fin.finalize(analysis(spark, sf_dir)))


def _mixed_choices(a: Analysis) -> DataFrame:
    """A decision for every conflict: keep whole, or one of the three sources, by id."""
    return a.conflicts.select("conflict_id", (F.col("gid") % 4 - 1).cast("int").alias("choice"))


def _mixed(spark: SparkSession, sf_dir: str) -> fin.Result:
    def make() -> fin.Result:
        a = analysis(spark, sf_dir)
        return fin.finalize(a, _mixed_choices(a))

    return _once(spark, sf_dir, "mixed", make)


def _cleaned(spark: SparkSession, sf_dir: str, *names: str) -> cleanup.Cleaned:
    chosen = {n: n in names for n in cleanup.DEFAULTS}
    return _once(spark, sf_dir, "clean " + " ".join(names),
                 lambda: cleanup.apply_cleanups(_default(spark, sf_dir).tables, [], chosen))


def _merged_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        a = analysis(spark, sf_dir)
        files = a.collected_media.select(F.col("FilePath").alias("path"))
        return fin.materialize(health.Health(_default(spark, sf_dir).tables, [], files).report(), "merged-health")

    return _once(spark, sf_dir, "health", make)


def _damaged(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """The damaged snapshots as stage tables, each written on first use; every source is a set of its own (key ``src``)."""
    def make() -> Mapping[str, DataFrame]:
        tables = derive.damaged_tables(spark, sf_dir)
        return MadeOnUse(tables, lambda n: fin.materialize(tables[n], f"damaged-{n}", compression="zstd"))

    return _once(spark, sf_dir, "damaged", make)


def _health_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """All checks on the damaged snapshots; every one has findings."""
    t = _damaged(spark, sf)
    found = health.Health(t, ["src"], t["media_files"].select("src", "path")).counts()
    return found.select("src", "code", F.col("count").cast("bigint").alias("count"))


def _health_members(spark: SparkSession, sf: str) -> DataFrame:
    """Every highlight of the groups of equal ones, and of those unlike in look, with the first of its group."""
    t = _damaged(spark, sf)
    rows = fin.materialize(health.Health(t, ["src"]).members(), "members")
    first = rows.where("nth = 1").select("src", "code", "group", F.col("UserMarkId").alias("first_id"))
    return rows.join(first, ["src", "code", "group"]).select("src", "code", "first_id", F.col("nth").cast("bigint").alias("nth"), "UserMarkId")


def _broken(check: Callable) -> Callable:
    return lambda spark, sf: check(_damaged(spark, sf), ["src"]).where("violations > 0")


def _write_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps the damaged snapshots from being published, children of rejected rows included."""
    rejects, _ = gate.find_rejects(_damaged(spark, sf), ["src"])
    return rejects.groupBy("src", "table", "rule").agg(F.count("*").alias("n"))


def _write_split(spark: SparkSession, sf: str) -> DataFrame:
    """The damaged snapshots published without their offending rows, proved and counted as read back."""
    root = f"{shared_dir(spark)}/braidset/out-{uuid.uuid4().hex}"
    gate.publish(_damaged(spark, sf), root, 1, ["src"], split=True)
    proof = gate.prove_published(spark, root, 1, [("src", "int")])
    return proof.select("table", "final", "same", "contents", "dangling")


def _cleanup_damaged(spark: SparkSession, sf: str) -> DataFrame:
    done = cleanup.apply_cleanups(_damaged(spark, sf), ["src"], {n: True for n in cleanup.DEFAULTS})
    return done.summary().select("src", "action", F.col("n").cast("bigint").alias("n"))


def _merged(table: str) -> Callable:
    return lambda spark, sf: analysis(spark, sf).merged(table)


def _lineage(table: str) -> Callable:
    return lambda spark, sf: analysis(spark, sf).lineage_of(table).drop("table")


def _conflicts(kind: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = analysis(spark, sf).conflicts_of(kind)
        return found.select("conflict_id", "identity_key", F.col("gid").cast("bigint").alias("gid"), F.col("n_candidates").cast("bigint").alias("n_candidates"),
                            "suggested_src", "decided_by", "context")

    return run


def _candidates(kind: str) -> Callable:
    return lambda spark, sf: analysis(spark, sf).candidates.where(F.col("kind") == kind).select(
        "conflict_id", "src", F.col("pk").cast("bigint").alias("pk"), "label", F.col("gid").cast("bigint").alias("gid"),
        "timestamp", "timestamp_source", "backup_timestamp",
    )


def _health(*codes: str) -> Callable:
    """Checks on the three sources, with their counts; checks without findings have no line."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        a = analysis(spark, sf)
        found = health.Health(a.tables, ["src"], a.media_files.select("src", "path")).counts(list(codes))
        return found.select("src", "code", F.col("count").cast("bigint").alias("count"))

    return run


def _codes(letter: str) -> list[str]:
    return [c[0] for c in health.CHECKS if c[0].startswith(letter)]


def _health_report(spark: SparkSession, sf: str) -> DataFrame:
    return _merged_health(spark, sf).select("code", "category", F.col("cleanup"), "info", F.col("count").cast("bigint").alias("count"))


def _health_samples(spark: SparkSession, sf: str) -> DataFrame:
    return _merged_health(spark, sf).where("count > 0").select("code", F.posexplode("samples").alias("nth", "sample"))


def _health_summary(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_summary(_merged_health(spark, sf), [])


def _cleanup_rows(table: str, *names: str) -> Callable:
    return lambda spark, sf: _cleaned(spark, sf, *names).tables[table]


def _cleanup_summary(spark: SparkSession, sf: str) -> DataFrame:
    done = _cleaned(spark, sf, *cleanup.DEFAULTS)
    lines = done.summary().select(F.col("action").alias("name"), "n")
    return lines.unionByName(done.removed().select(F.concat(F.lit("removed "), "table").alias("name"), F.col("removed").alias("n")))


def _validate_keyed(check: Callable) -> Callable:
    return lambda spark, sf: check(analysis(spark, sf).tables, ["src"])


def _merged_fk(spark: SparkSession, sf: str) -> DataFrame:
    return validate.fk_violations(_default(spark, sf).tables, [])


def _reconcile(spark: SparkSession, sf: str) -> DataFrame:
    a = analysis(spark, sf)
    done = _cleaned(spark, sf, *cleanup.DEFAULTS)
    return validate.reconcile_counts(
        report.source_counts(a), report.dropped_counts(a), fin.table_counts(done.tables, []), done.removed(), []
    )


def _reconcile_counts(spark: SparkSession, sf: str) -> DataFrame:
    numbers = ["max_source", "max_carried", "sum_source", "final", "removed"]
    return _reconcile(spark, sf).select("table", *[F.col(c).cast("bigint").alias(c) for c in numbers], "ok")


def _validation(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on the default result, before any clean-up."""
    a, result = analysis(spark, sf), _default(spark, sf)
    counts = validate.reconcile_counts(
        report.source_counts(a), report.dropped_counts(a), fin.table_counts(result.tables, []), None, []
    )
    done = validate.validation_report(validate.fk_violations(result.tables, []), counts, [])
    return done.select("ok", F.col("foreign_key_violations").cast("bigint").alias("foreign_key_violations"),
                       F.size("errors").cast("bigint").alias("n_errors"))


def _written(spark: SparkSession, sf: str) -> str:
    """Folder of the default result, published as version 1."""
    root = f"{shared_dir(spark)}/braidset/out-{uuid.uuid4().hex}"
    gate.publish(_default(spark, sf).tables, root, 1, [])
    return root


def _roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The default result checked, written and published; rows, contents and references as read back."""
    return gate.prove_published(spark, _written(spark, sf), 1)


def _roundtrip_changed(spark: SparkSession, sf: str) -> DataFrame:
    """The same after a cell of the written notes was changed and the written accuracies were lost."""
    root = _written(spark, sf)
    folders = gate.marker(spark, root, 1)
    notes = gate.read_published(spark, root, 1)["Note"]
    changed = notes.withColumn("Title", F.when(F.col("NoteId") == 1, F.concat(F.coalesce("Title", F.lit("")), F.lit("!"))).otherwise(F.col("Title")))
    changed = fin.materialize(changed, "changed-notes")
    changed.write.mode("overwrite").parquet(f"{root}/{folders['Note']['folder']}")
    spark.createDataFrame([], schema.struct_type("PlaylistItemAccuracy")).write.mode("overwrite").parquet(f"{root}/{folders['PlaylistItemAccuracy']['folder']}")
    return gate.prove_published(spark, root, 1)


def _build_report(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on the cleaned result as published and read back, with the media files it keeps."""
    a, done = analysis(spark, sf), _cleaned(spark, sf, *cleanup.DEFAULTS)
    root = f"{shared_dir(spark)}/braidset/out-{uuid.uuid4().hex}"
    gate.publish(done.tables, root, 1, [])
    seen = report.build_report(a, _default(spark, sf), done, gate.read_published(spark, root, 1))
    long = lambda c: F.col(c).cast("bigint").alias(c)
    one = F.lit(1).alias("_one")
    return seen["validation"].select("*", one).join(seen["media"].select("*", one), "_one").select(
        "ok", long("foreign_key_violations"), long("rules_broken"), long("tables_changed"), F.size("errors").cast("bigint").alias("n_errors"), long("n_files"))


def _traceability(spark: SparkSession, sf: str) -> DataFrame:
    a, result = analysis(spark, sf), _default(spark, sf)
    done = validate.check_traceability(a.tables, a.lineage, result.tables, result.decisions, [])
    return done.select("table", *[F.col(c).cast("bigint").alias(c) for c in ("untraced", "missing", "leaked", "dropped")])


def _about(a: Analysis) -> DataFrame:
    return a.compatibility.select(
        F.lit("merged.zip").alias("FileName"), F.lit("Merged").alias("DeviceName"), F.col("schema_version").alias("SchemaVersion"),
        F.col("migration_id").alias("MigrationId"), F.col("user_version").alias("UserVersion"), F.col("latest_last_modified").alias("LastModified"),
    )


def _sound(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The default result without references to no row (as a result must be that goes on being merged)."""
    return _once(spark, sf, "sound", lambda: {n: fin.materialize(df, f"sound-{n}") for n, df in gate.find_rejects(_default(spark, sf).tables, [])[1].items()})


def _remerge(spark: SparkSession, sf: str) -> DataFrame:
    """The default result arrives once more as a late snapshot of itself: every table keeps its contents, ids included."""
    result, about = _sound(spark, sf), _about(analysis(spark, sf))
    late = {name: df.withColumn("src", F.lit(0)) for name, df in result.items()}
    again = merge_late(result, about, late, about.withColumn("src", F.lit(0))).finalize()
    before = validate.fingerprint(result, []).withColumnRenamed("digest", "before").drop("n")
    after = validate.fingerprint({t: again.tables[t].select(result[t].columns) for t in result}, [])
    return after.join(before, "table").select("table", "n", (F.col("digest") == F.col("before")).alias("same"))


def _late(spark: SparkSession, sf: str) -> fin.Result:
    """Two snapshots merged, then the third as a late one: rows both know, changed rows and new ones."""
    def make() -> fin.Result:
        tables, sources = derive.snapshot_tables(spark, sf), derive.derived(spark, sf, "sources")
        files = derive.media_files(spark, sf)
        early = Analysis(MadeOnUse(tables, lambda t: tables[t].where("src < 2")), sources.where("src < 2"), [], files.where("src < 2"))
        first = fin.finalize(early).tables
        first = gate.accepted_rows(first, [])
        third = MadeOnUse(tables, lambda t: tables[t].where("src = 2").withColumn("src", F.lit(0)))
        return merge_late(first, _about(early), third, sources.where("src = 2").withColumn("src", F.lit(0)), [],
                          files.where("src = 2").withColumn("src", F.lit(0))).finalize()

    return _once(spark, sf, "late", make)


def _late_notes(spark: SparkSession, sf: str) -> DataFrame:
    notes = _late(spark, sf).tables["Note"]
    return notes.select("Guid", "Title", "Content", "LastModified")


def _late_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fin.table_counts({t: _late(spark, sf).tables[t] for t in ("Location", "UserMark", "Note", "Tag", "IndependentMedia", "InputField", "Bookmark")}, [])


def _auto_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.auto_summary(analysis(spark, sf))


def _warnings(spark: SparkSession, sf: str) -> DataFrame:
    return report.warnings(analysis(spark, sf)).select("stage", "src", "code", "subject")


def _decision_log(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).decisions.select("conflict_id", "kind", "winner_src", "was_suggested", "kept_both", "overridden")


def _decision_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.decision_summary(_mixed(spark, sf).decisions, [])


def _resolution_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions after a round of edits: every third is reset, every fifth set to source 2."""
    a = analysis(spark, sf)
    edits = a.conflicts.where("gid % 3 = 0 OR gid % 5 = 0").select(
        "conflict_id", F.when(F.col("gid") % 5 == 0, 2).cast("int").alias("choice"), F.col("gid").alias("seq")
    )
    return update_resolutions(_mixed_choices(a), edits, [])


def _identical(spark: SparkSession, sf: str) -> DataFrame:
    notes = analysis(spark, sf).note.extra["candidates"]
    same = mark_identical(notes, ["conflict_id"], K.key_of("Title", "Content"))
    return same.select("conflict_id", "src", "same_as")


def _text_change(spark: SparkSession, sf: str) -> DataFrame:
    """Words changed between the suggested note and each other candidate."""
    a = analysis(spark, sf)
    notes = a.note.extra["candidates"].select("conflict_id", "src", "Content")
    chosen = a.conflicts_of("note").select("conflict_id", F.col("suggested_src").alias("src")).join(notes, ["conflict_id", "src"])
    pairs = notes.join(chosen.select("conflict_id", F.col("src").alias("best"), F.col("Content").alias("kept")), "conflict_id").where("src <> best")
    return X.text_change(pairs, ["conflict_id", "src"], "Content", "kept")


def _longest(spark: SparkSession, sf: str) -> DataFrame:
    notes = analysis(spark, sf).note.extra["candidates"]
    return report.longest_text(notes, ["conflict_id"]).select("conflict_id", F.col("longest").cast("bigint").alias("longest"))


def _page(spark: SparkSession, sf: str) -> DataFrame:
    return report.page(analysis(spark, sf).conflicts_of("note"), [], "note", 0).select("conflict_id", F.col("gid").cast("bigint").alias("gid"))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    a = analysis(spark, sf)
    counts = fin.table_counts(_default(spark, sf).tables, [])
    everything = {n: True for n in cleanup.DEFAULTS}
    return report.predict_counts(counts, _mixed(spark, sf).decisions, _merged_health(spark, sf), [], everything)


def _preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.cleanup_preview(_merged_health(spark, sf), [])
    return rows.select("cleanup", "enabled", F.col("predicted").cast("bigint").alias("predicted"))


def _headline(spark: SparkSession, sf: str) -> DataFrame:
    return report.headline_counts(_default(spark, sf).tables, [])


def _source_summary(spark: SparkSession, sf: str) -> DataFrame:
    numbers = ["n_rows", "n_tables", "n_playlists", "n_files"]
    return report.source_summary(analysis(spark, sf)).select("src", "label", "LastModified", *[F.col(c).cast("bigint").alias(c) for c in numbers])


def _compatibility(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf).compatibility.select(
        "ok", F.size("errors").alias("n_errors"), F.array_join("warnings", "; ").alias("warnings"), "schema_version", "template_src",
        "migration_id", "user_version", "latest_last_modified", "n_sources",
    )


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels when every nation exports once per region name: repeats are numbered."""
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    regions = spark.read.parquet(f"{sf}/region.parquet")
    named = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("upload"), F.when(F.col("n_nationkey") % 4 != 0, F.col("r_name")).alias("DeviceName"),
        F.when(F.col("n_nationkey") % 8 != 0, F.col("n_name")).alias("FileName"),
    )
    return compatibility.label_sources(compatibility.reindex_sources(named, [], "upload"), []).select("src", "label")


def _template(spark: SparkSession, sf: str) -> DataFrame:
    """Per region, the nation with the highest migration number."""
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(
        "n_regionkey", F.col("n_nationkey").alias("src"), F.concat(F.lit("v"), F.col("n_nationkey") % 7).alias("MigrationId")
    )
    return compatibility.elect_template(nations, ["n_regionkey"])


def _collected(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf).collected_media.select(F.col("gid").cast("bigint").alias("gid"), "FilePath", "src", "path")


def _media_bytes(spark: SparkSession, sf: str) -> DataFrame:
    a = analysis(spark, sf)
    return io.collect_media(a.collected_media, a.media_files, []).select(
        "FilePath", F.length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256")
    )


def _media_renames(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf).media.merged.where("renamed").select(F.col("IndependentMediaId").cast("bigint").alias("IndependentMediaId"), "Hash", "FilePath")


def _slots(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf).bookmark.merged.select(
        F.col("BookmarkId").cast("bigint").alias("BookmarkId"), F.col("PublicationLocationId").cast("bigint").alias("PublicationLocationId"), "own_slot", "Slot"
    )


def _digest(spark: SparkSession, sf: str) -> DataFrame:
    return validate.content_digest(analysis(spark, sf).merged("Location"), [], schema.columns("Location"))


def _fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    a = analysis(spark, sf)
    return validate.fingerprint({t: a.merged(t) for t in schema.TABLES}, [])


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    a = analysis(spark, sf)
    made = io.build_manifest(a.compatibility, validate.fingerprint(_default(spark, sf).tables, []), [], 1_788_706_800_000)
    read = manifest.parse_manifest(made, "manifest")
    return read.select("name", "version", "type", "lastModifiedDate", "deviceName", "databaseName", "schemaVersion")


def _admit(spark: SparkSession, sf: str) -> DataFrame:
    """Pages offered as files: name by page group, size by html length, some empty or huge."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    offered = pages.select(
        "page_id",
        F.concat(F.lit("f"), F.col("page_id") % 7, F.when(F.col("page_id") % 11 == 0, ".txt").when(F.col("page_id") % 2 == 0, ".ZIP").otherwise(".zip")).alias("name"),
        F.when(F.col("page_id") % 13 == 0, F.lit(0)).when(F.col("page_id") % 17 == 0, F.lit(3 * 1024**3))
        .otherwise(F.length("html") % 40).cast("bigint").alias("size"),
    )
    return manifest.admit_files(offered, ".zip", "page_id")


def _manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The properties of every event wrapped as a manifest, some of them unusable."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    version = F.when(F.col("event_id") % 5 == 0, '"16"').when(F.col("event_id") % 7 == 0, "null").otherwise(F.get_json_object("props", "$.k"))
    body = F.concat(
        F.lit('{"name": "'), "event_type", F.lit('", "userDataBackup": {"deviceName": "d'), F.col("user_id"),
        F.lit('", "schemaVersion": '), F.coalesce(version, F.lit("null")), F.lit("}}"),
    )
    body = F.when(F.col("event_id") % 9 == 0, F.col("event_type")).when(F.col("event_id") % 10 == 0, F.col("props")).otherwise(body)
    read = manifest.parse_manifest(events.select("event_id", body.alias("body")), "body")
    return read.select("event_id", "error", "name", "deviceName", "databaseName", "version", "type", "schemaVersion")


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.media_inventory(analysis(spark, sf).media_files, ["src"])


def _ts_order(spark: SparkSession, sf: str) -> DataFrame:
    """Event times in five text shapes: normal form, instant, output forms."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.concat(base, F.lit("Z"))).when(k == 1, F.concat(base, F.lit(".1234567Z")))
        .when(k == 2, F.concat(base, F.lit("-0400"))).when(k == 3, F.concat(F.replace(base, F.lit("T"), F.lit(" "))))
        .when(k == 4, F.concat(base, F.lit("+05:30"))).otherwise(F.concat(F.lit("about "), base))
    )
    shaped = events.select("event_id", raw.alias("raw"))
    key = TS.ts_key("raw")
    return shaped.select(
        "event_id", TS.normalize_ts("raw").alias("normal"), TS.parse_ts("raw").alias("ms"), key["ok"].alias("ok"), key["txt"].alias("txt"),
        TS.format_utc(TS.parse_ts("raw")).alias("utc"), TS.offset_form("raw").alias("offset_form"),
    )


def _normalize(spark: SparkSession, sf: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    padded = F.concat(F.lit("  \t"), F.replace("text", F.lit(" "), F.lit(" \t")), F.lit("\r\n﻿"))
    return documents.select("doc_id", X.normalize_text(padded).alias("normal"), X.is_blank("text").alias("blank"))


def _describe(spark: SparkSession, sf: str) -> DataFrame:
    a = analysis(spark, sf)
    return a.tables["Location"].select("src", "LocationId", X.describe_location().alias("text"))


def _guid(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf}/part.parquet")
    seed = F.concat_ws("|", "p_name", "p_brand", F.col("p_partkey").cast("string"))
    return parts.select("p_partkey", hashing.fnv1a32(seed).alias("fnv"), hashing.stable_guid(seed).alias("guid"))


def _device(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    names = F.array(*[F.lit(n) for n in ("My iPad", "iPhone 15", "tab s9", "Windows PC", "iMac", "stable", "Pixel tablet", "x", "MacBook", "phone")])
    name = F.concat(F.element_at(names, (F.col("user_id") % 10 + 1).cast("int")), F.lit(" of "), "event_type")
    return events.select("event_id", X.device_kind(name).alias("kind"))


def _bytes(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/orders.parquet")
    size = F.floor(F.col("o_totalprice") * F.pow(F.lit(8.0), F.col("o_orderkey") % 8)).cast("bigint")
    return lines.select("o_orderkey", size.alias("size"), X.plural(size, "byte").alias("plural"), X.format_bytes(size).alias("text"))


def _colors(spark: SparkSession, sf: str) -> DataFrame:
    marks = analysis(spark, sf).tables["UserMark"]
    shifted = (F.col("ColorIndex") * 2 - 2).cast("int")
    return marks.groupBy(X.color_name(shifted).alias("name"), X.color_hex(shifted).alias("hex")).agg(F.count("*").alias("n"))


def _extensions(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", X.file_base("url").alias("base"), X.file_extension("url").alias("ext"), X.path_key("url").alias("path_key"))


def _location_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = analysis(spark, sf).tables["Location"].select("src", "LocationId", F.explode(K.location_keys()).alias("k"))
    return rows.select("src", "LocationId", "k.rank", F.translate("k.key", K.KEY_SEPARATOR + K.NULL_TOKEN, "|~").alias("key"))


_CHECKS = {f"health_{c.lower()}": _health(c) for c in _codes("A") + _codes("B") + _codes("C") + _codes("D")}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "merge_notes": _merged("Note"),
    "note_conflicts": _conflicts("note"),
    "note_candidates": _candidates("note"),
    "merge_locations": _merged("Location"),
    "merge_locations_tangled": lambda spark, sf: _tangled(spark, sf).merged("Location"),
    "merge_user_marks": _merged("UserMark"),
    "mark_conflicts": _conflicts("userMark"),
    "mark_candidates": _candidates("userMark"),
    "merge_block_ranges": _merged("BlockRange"),
    "merge_media": _merged("IndependentMedia"),
    "media_renames": _media_renames,
    "collected_media": _collected,
    "media_bytes": _media_bytes,
    "merge_bookmarks": _merged("Bookmark"),
    "bookmark_slots": _slots,
    "merge_input_fields": _merged("InputField"),
    "input_field_conflicts": _conflicts("inputField"),
    "merge_tags": _merged("Tag"),
    "merge_accuracy": _merged("PlaylistItemAccuracy"),
    "merge_playlist_items": _merged("PlaylistItem"),
    "merge_item_locations": _merged("PlaylistItemLocationMap"),
    "merge_item_media": _merged("PlaylistItemIndependentMediaMap"),
    "merge_markers": _merged("PlaylistItemMarker"),
    "merge_marker_verses": _merged("PlaylistItemMarkerBibleVerseMap"),
    "merge_marker_paragraphs": _merged("PlaylistItemMarkerParagraphMap"),
    "merge_tag_map": _merged("TagMap"),
    **{f"lineage_{t.lower()}": _lineage(t) for t in schema.TABLES},
    "dropped_counts": lambda spark, sf: report.dropped_counts(analysis(spark, sf)),
    "source_counts": lambda spark, sf: report.source_counts(analysis(spark, sf)),
    "sum_counts": lambda spark, sf: report.sum_counts(report.source_counts(analysis(spark, sf)), []).select("table", F.col("n").cast("bigint").alias("n")),
    "conflict_counts": lambda spark, sf: report.conflict_counts(analysis(spark, sf)),
    "warnings": _warnings,
    "auto_summary": _auto_summary,
    "finalize_default": lambda spark, sf: _default(spark, sf).tables["Note"],
    "finalize_notes": lambda spark, sf: _mixed(spark, sf).tables["Note"],
    "finalize_marks": lambda spark, sf: _mixed(spark, sf).tables["UserMark"],
    "finalize_ranges": lambda spark, sf: _mixed(spark, sf).tables["BlockRange"],
    "finalize_input_fields": lambda spark, sf: _mixed(spark, sf).tables["InputField"],
    "decision_log": _decision_log,
    "decision_summary": _decision_summary,
    "resolution_edits": _resolution_edits,
    "identical_candidates": _identical,
    "text_change": _text_change,
    "longest_text": _longest,
    "conflict_page": _page,
    "cleanup_empty_notes": _cleanup_rows("Note", "emptyNotes"),
    "cleanup_rangeless_marks": _cleanup_rows("UserMark", "rangelessHighlights"),
    "cleanup_detached_notes": lambda spark, sf: _cleaned(spark, sf, "rangelessHighlights").tables["Note"].select("NoteId", "UserMarkId"),
    "cleanup_duplicate_marks": _cleanup_rows("UserMark", "duplicateHighlights"),
    "cleanup_reattached_notes": lambda spark, sf: _cleaned(spark, sf, "duplicateHighlights").tables["Note"].select("NoteId", "UserMarkId"),
    "cleanup_unused_media": _cleanup_rows("IndependentMedia", "unusedMedia"),
    "cleanup_empty_playlists": _cleanup_rows("Tag", "emptyPlaylists"),
    "cleanup_unreferenced_locations": _cleanup_rows("Location", "unreferencedLocations"),
    "cleanup_all": _cleanup_summary,
    "cleanup_preview": _preview,
    "predict_counts": _predicted,
    **_CHECKS,
    "health_report": _health_report,
    "health_samples": _health_samples,
    "health_summary": _health_summary,
    "fk_violations": _validate_keyed(validate.fk_violations),
    "fk_violations_merged": _merged_fk,
    "constraint_violations": _validate_keyed(validate.constraint_violations),
    "unique_violations": _validate_keyed(validate.unique_violations),
    "reconcile_counts": _reconcile_counts,
    "validation_report": _validation,
    "build_report": _build_report,
    "roundtrip": _roundtrip,
    "roundtrip_changed": _roundtrip_changed,
    "health_damaged": _health_damaged,
    "health_members": _health_members,
    "row_rules_damaged": _broken(validate.constraint_violations),
    "unique_damaged": _broken(validate.unique_violations),
    "references_damaged": _broken(validate.fk_violations),
    "write_rejects": _write_rejects,
    "write_split": _write_split,
    "cleanup_damaged": _cleanup_damaged,
    "traceability": _traceability,
    "idempotent_remerge": _remerge,
    "late_notes": _late_notes,
    "late_counts": _late_counts,
    "content_digest": _digest,
    "fingerprint": _fingerprint,
    "output_manifest": _manifest,
    "compatibility": _compatibility,
    "source_labels": _labels,
    "template": _template,
    "source_summary": _source_summary,
    "headline_counts": _headline,
    "admit_files": _admit,
    "manifest_scan": _manifest_scan,
    "media_inventory": _inventory,
    "ts_order": _ts_order,
    "normalize_text": _normalize,
    "describe_location": _describe,
    "location_keys": _location_keys,
    "fnv_guid": _guid,
    "device_kind": _device,
    "format_bytes": _bytes,
    "color_dim": _colors,
    "split_ext": _extensions,
}
