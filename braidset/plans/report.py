"""Reports over an analysis and its result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from braidset import schema
from braidset.plans.analyze import Analysis
from braidset.plans.cleanup import CLEANED_TABLE, DEFAULTS
from braidset.plans.finalize import table_counts

# Highest slot shown per publication; bookmarks beyond it are kept with a warning.
LAST_SHOWN_SLOT = 9


def source_counts(analysis: Analysis) -> DataFrame:
    """``[*scope, src, table, n]``."""
    return table_counts(analysis.tables, [*analysis.scope, "src"])


def sum_counts(counts: DataFrame, scope: list[str]) -> DataFrame:
    return counts.groupBy(*scope, "table").agg(F.sum("n").alias("n"))


def dropped_counts(analysis: Analysis) -> DataFrame:
    """Rows each source could not carry over: ``[*scope, src, table, dropped]``."""
    return analysis.lineage.where("kind = 'dropped'").groupBy(*analysis.scope, "src", "table").agg(F.count("*").alias("dropped"))


def auto_summary(analysis: Analysis) -> DataFrame:
    """What was resolved without asking, in long form ``[*scope, counter, n]``, zero counters left out."""
    sc = analysis.scope
    lineage = analysis.lineage
    names = {
        "Location": "locationsDeduped", "UserMark": "userMarksDeduped", "BlockRange": "blockRangesDeduped",
        "Note": "notesDeduped", "Bookmark": "bookmarksDeduped", "InputField": "inputFieldsDeduped",
        "IndependentMedia": "mediaDeduped", "PlaylistItemAccuracy": "playlistItemAccuraciesDeduped",
        "PlaylistItem": "playlistItemsDeduped", "TagMap": "tagMapsDeduped",
    }
    label = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    merged = lineage.where(F.col("kind") == "mapped").where("merged_into").where(F.col("table").isin(*names))
    parts = [merged.groupBy(*sc, label[F.col("table")].alias("counter")).agg(F.count("*").alias("n"))]

    def counted(df: DataFrame, counter: Column | str) -> DataFrame:
        name = F.lit(counter) if isinstance(counter, str) else counter
        return df.groupBy(*sc, name.alias("counter")).agg(F.count("*").alias("n"))

    tags = analysis.tag.extra["rows"].where("NOT created")
    kind = F.when(F.col("Type") == schema.PLAYLIST_TYPE, "playlistsMergedByName").otherwise("tagsMerged")
    parts += [
        counted(analysis.location.merged.where("title_normalized"), "locationTitlesNormalized"),
        counted(analysis.bookmark.merged.where("Slot <> own_slot"), "bookmarksRenumbered"),
        counted(analysis.media.merged.where("renamed"), "mediaRenamed"),
        counted(tags, kind),
        counted(analysis.tag_map.merged.where("Position <> own_position"), "tagPositionsRenumbered"),
    ]
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def warnings(analysis: Analysis) -> DataFrame:
    """What a reader should know about rows left out or changed: ``[*scope, stage, src, code, subject, message]``."""
    sc = analysis.scope

    def about(df: DataFrame, stage: str, code: str, subject: Column, text: str) -> DataFrame:
        return df.select(
            *sc, F.lit(stage).alias("stage"), "src", F.lit(code).alias("code"), subject.cast("string").alias("subject"), F.lit(text).alias("_text")
        )

    copies = analysis._mark_copies
    notes = analysis._note_copies
    ranges = analysis.block_range.ids.where("kind = 'dropped'")
    items = analysis._items
    assignments = analysis.tag_map.extra["copies"]
    creators = analysis.media.extra["paths"].where("created")
    files = analysis._files().select(*sc, "src", F.col("path").alias("FilePath"))
    links = [
        (analysis.item_location, "PlaylistItemLocationMap", "location", "dangling LocationId"),
        (analysis.item_media, "PlaylistItemIndependentMediaMap", "media row", "dangling IndependentMediaId"),
    ]
    owning = analysis.playlist_item.ids.where("NOT merged_into").select(*sc, "src", F.col("local_id").alias("pk"))
    lost_thumbs = items.where("acc IS NOT NULL AND ThumbnailFilePath IS NOT NULL AND thumb_path IS NULL").join(owning, [*sc, "src", "pk"], "left_semi")
    missing_tag = assignments.where("tag IS NULL").groupBy(*sc, "src", "TagId").agg(F.count("*").alias("n"))
    parts = [
        about(copies.where("loc IS NULL"), "UserMark", "missing location", F.col("UserMarkGuid"), "highlight {} names a missing location and was left out"),
        about(creators.join(files, [*sc, "src", "FilePath"], "left_anti"), "IndependentMedia", "missing file", F.col("FilePath"),
              "media file {} is not in the archive, its row is kept"),
        about(ranges.where("reason = 'unpaired duplicate'"), "BlockRange", "unpaired range", F.col("local_id"), "range {} has no counterpart and was left out"),
        about(ranges.where("reason = 'dangling UserMarkId'"), "BlockRange", "missing highlight", F.col("local_id"), "range {} has no highlight and was left out"),
        about(notes.where("UserMarkId IS NOT NULL AND mark IS NULL"), "Note", "highlight link cleared", F.col("Guid"), "note {} named a missing highlight, the link was cleared"),
        about(notes.where("LocationId IS NOT NULL AND loc IS NULL"), "Note", "location link cleared", F.col("Guid"), "note {} named a missing location, the link was cleared"),
        about(analysis.bookmark.ids.where("kind = 'dropped'"), "Bookmark", "missing location", F.col("local_id"), "bookmark {} names a missing location and was left out"),
        about(analysis.bookmark.merged.where(f"Slot <> own_slot AND Slot > {LAST_SHOWN_SLOT}"), "Bookmark", "slot out of sight", F.col("Title"),
              f"bookmark {{}} went to a slot beyond the {LAST_SHOWN_SLOT + 1} shown"),
        about(analysis.input_field.ids.where("kind = 'dropped'"), "InputField", "missing location", F.element_at(F.split("local_key", "\u001f"), 2),
              "input field {} names a missing location and was left out"),
        about(items.where("acc IS NULL"), "PlaylistItem", "missing accuracy", F.col("Label"), "playlist item {} names a missing accuracy and was left out"),
        about(lost_thumbs, "PlaylistItem", "thumbnail cleared", F.col("Label"), "the thumbnail of playlist item {} has no media row and was cleared"),
        *[about(s.ids.where(F.col("reason") == reason), table, f"missing {what}", F.col("local_key"), f"playlist link {{}} names a missing {what} and was left out")
          for s, table, what, reason in links],
        about(missing_tag, "TagMap", "missing tag", F.col("TagId"), "the assignments of missing tag {} were left out"),
        about(assignments.where("tag IS NOT NULL AND ref IS NULL"), "TagMap", "missing target", F.col("pk"), "tag assignment {} names a target that is gone and was left out"),
    ]
    labelled = analysis.with_source(reduce(DataFrame.unionByName, parts))
    message = F.concat(F.col("label"), F.lit(": "), F.replace("_text", F.lit("{}"), F.col("subject")))
    return labelled.select(*sc, "stage", "src", "code", "subject", message.alias("message"))


def conflict_counts(analysis: Analysis) -> DataFrame:
    return analysis.conflicts.groupBy(*analysis.scope, "kind").agg(F.count("*").alias("n"))


def decision_summary(decisions: DataFrame, scope: list[str]) -> DataFrame:
    """How many conflicts, how many decided against the suggestion, how many kept whole."""
    return decisions.groupBy(*scope, "kind").agg(
        F.count("*").alias("conflicts"), F.count(F.when(F.col("overridden"), 1)).alias("overridden"),
        F.count(F.when(F.col("kept_both"), 1)).alias("kept_both"),
    )


def longest_text(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the longest candidate text (title included) of each conflict."""
    size = sum((F.length(F.coalesce(F.col(c), F.lit(""))) for c in ("Title", "Content", "Value") if c in candidates.columns), F.lit(0))
    return candidates.groupBy(*keys).agg(F.max(size).alias("longest"))


def page(conflicts: DataFrame, scope: list[str], kind: str | None, number: int, size: int = 15) -> DataFrame:
    """One page of conflicts, optionally of one kind, in a fixed order."""
    chosen = conflicts if kind is None else conflicts.where(F.col("kind") == kind)
    return chosen.orderBy(*scope, "kind", "gid", "conflict_id").offset(number * size).limit(size)


def headline_counts(tables: dict[str, DataFrame], scope: list[str]) -> DataFrame:
    """Tags split into playlists and ordinary tags."""
    lists = F.col("Type") == schema.PLAYLIST_TYPE
    return tables["Tag"].groupBy(*scope).agg(
        F.count(F.when(lists, 1)).alias("playlists"), F.count(F.when(~lists, 1)).alias("tags")
    )


def predict_counts(counts: DataFrame, decisions: DataFrame, findings: DataFrame, scope: list[str], options: dict[str, bool] | None = None) -> DataFrame:
    """Row counts the current decisions and clean-ups would give, without building anything.

    ``counts`` are those of the default result, ``findings`` a health report of it; each
    enabled clean-up subtracts its finding, never below zero.
    """
    by = [*scope, "table"]
    chosen = {**DEFAULTS, **(options or {})}
    table_of = F.when(F.col("kind") == "note", "Note").when(F.col("kind") == "userMark", "UserMark")
    extra = decisions.where("kept_both").groupBy(*scope, table_of.alias("table")).agg(F.sum(F.col("n_candidates") - 1).alias("extra"))
    out = counts.join(extra, by, "left").withColumn("predicted", F.col("n") + F.coalesce("extra", F.lit(0)))
    for name, table in CLEANED_TABLE.items():
        if chosen[name]:
            found = findings.where(F.col("cleanup") == name).select(*scope, F.lit(table).alias("table"), F.col("count").alias("_found"))
            out = out.join(F.broadcast(found) if not scope else found, by, "left").withColumn(
                "predicted", F.greatest(F.lit(0).cast("bigint"), F.col("predicted") - F.coalesce("_found", F.lit(0)))
            ).drop("_found")
    return out.select(*by, "n", F.col("predicted").cast("bigint").alias("predicted"))


def cleanup_preview(findings: DataFrame, scope: list[str], options: dict[str, bool] | None = None) -> DataFrame:
    """Each clean-up with its switch and what it would remove."""
    chosen = {**DEFAULTS, **(options or {})}
    switch = F.create_map(*[F.lit(v) for pair in chosen.items() for v in pair])
    return findings.where("cleanup IS NOT NULL").select(
        *scope, "cleanup", switch[F.col("cleanup")].alias("enabled"), F.col("count").alias("predicted")
    )


def source_summary(analysis: Analysis) -> DataFrame:
    """One row per source: registry columns, label, row, playlist and file counts."""
    sc = analysis.scope
    key = [*sc, "src"]
    rows = source_counts(analysis).groupBy(*key).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_tables"))
    lists = analysis.tables["Tag"].groupBy(*key).agg(F.count(F.when(F.col("Type") == schema.PLAYLIST_TYPE, 1)).alias("n_playlists"))
    files = analysis._files().groupBy(*key).agg(F.count("*").alias("n_files"))
    out = analysis.sources.join(rows, key, "left").join(lists, key, "left").join(files, key, "left")
    return out.fillna(0, ["n_rows", "n_tables", "n_playlists", "n_files"])


def analysis_report(analysis: Analysis) -> dict[str, DataFrame]:
    """What a reader sees before deciding: small DataFrames by name, computed when used."""
    from braidset.plans.finalize import finalize
    from braidset.plans.health import Health

    default = finalize(analysis)
    files = analysis.collected_media.select(*analysis.scope, F.col("FilePath").alias("path"))
    owners = analysis.sources.select(*analysis.scope).distinct() if analysis.scope else None
    return {
        "sources": source_summary(analysis),
        "compatibility": analysis.compatibility,
        "conflicts": analysis.conflicts,
        "counters": auto_summary(analysis),
        "warnings": warnings(analysis),
        "counts": table_counts(default.tables, analysis.scope),
        "health": Health(default.tables, analysis.scope, files).report(owners),
        "headline": headline_counts(default.tables, analysis.scope),
        "media": files.groupBy(*analysis.scope).agg(F.count("*").alias("n_files")),
    }


def build_report(analysis: Analysis, result, cleaned, written: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """What a reader sees after building: verdict, counts, broken rules, clean-ups, digests, media left.

    With ``written`` (the tables read back from storage) the verdict is about those: as many rows as the result has, with the same
    contents, no broken rule and no dangling reference.
    """
    from braidset.plans.validate import broken_rules, fingerprint, fk_violations, reconcile_counts, same_contents, validation_report

    sc, tables = analysis.scope, cleaned.tables if written is None else written
    counts = reconcile_counts(
        source_counts(analysis), dropped_counts(analysis), table_counts(tables, sc), cleaned.removed(), sc,
        None if written is None else table_counts(cleaned.tables, sc),
    )
    roundtrip = None if written is None else same_contents(cleaned.tables, written, sc)
    rules = broken_rules(tables, sc)
    media = analysis.collected_media.select(*sc, "FilePath").join(
        tables["IndependentMedia"].select(*sc, "FilePath"), [*sc, "FilePath"], "left_semi"
    )
    return {
        "validation": validation_report(fk_violations(tables, sc), counts, sc, roundtrip, rules),
        "row_counts": counts,
        "rules": rules,
        "decisions": result.decisions,
        "cleanup": cleaned.summary(),
        "digests": fingerprint(tables, sc),
        "media": media.groupBy(*sc).agg(F.count("*").alias("n_files")),
    }
