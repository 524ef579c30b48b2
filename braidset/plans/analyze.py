"""Analysis: match, remap and compare every table of a snapshot set.

Stages run parents first and are computed on first use. Each writes its results once
(``materialize``), so later stages, other outputs and retries read tables instead of
recomputing the whole chain. Row counts of stage results follow the input; nothing is
collected on the driver.

Id tables have ``[*scope, src, local_id, gid, kind, merged_into, conflict_id, reason]``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from braidset import schema
from braidset.functions import keys as K
from braidset.functions.text import describe_location, is_blank, normalize_text
from braidset.functions.timestamps import ts_key
from braidset.operators import conflicts as C
from braidset.operators.match import allocate_ids, keep_ids, match_by_key, match_multi_key, match_or_allocate, number_entities
from braidset.operators.ordinals import SORTED, crowded_groups, ordinal_within
from braidset.operators.positions import append_positions, fill_slots, rename_collisions
from braidset.operators.remap import remap, remap_any
from braidset.plans.compatibility import check_compatibility, label_sources
from braidset.session import MadeOnUse, materialize

LINEAGE = ["table", "local_key", "kind", "global_key", "merged_into", "conflict_id", "reason"]


class IncompatibleSources(ValueError):
    """Raised when the sources of a scope cannot be reconciled.

    ``report`` is the DataFrame of all failing scopes with their errors; the message quotes one of them.
    """

    def __init__(self, report: DataFrame) -> None:
        first = report.select("errors").first()
        super().__init__("; ".join(first["errors"]) if first else "no sources were given")
        self.report = report


@dataclass
class Stage:
    """Result of one table: merged rows, id table or lineage, and what the stage adds."""

    merged: DataFrame
    ids: DataFrame
    extra: dict


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


class Analysis:
    """Lazily computed analysis of one snapshot set; incompatible sources are refused.

    ``tables`` maps table names to DataFrames with ``[*scope, src, *registry columns]``;
    missing names mean empty tables. ``media_files`` has ``[*scope, src, path]`` and, for
    writing, ``content``. With ``tops`` (table to ``[*scope, _top]``) source 0 is part of an earlier result whose rows keep their
    ids; new ids start above the tops.
    """

    def __init__(self, tables: Mapping[str, DataFrame], sources: DataFrame, scope: list[str] | None = None,
                 media_files: DataFrame | None = None, tops: Mapping[str, DataFrame] | None = None) -> None:
        self.scope = list(scope or [])
        self.tops = {} if tops is None else tops
        self.spark = sources.sparkSession
        self.media_files = media_files
        self._conflicts: dict[str, DataFrame] = {}
        self.sources = self._save(label_sources(sources, self.scope), "sources")
        head = [*self.scope, "src"]
        types = {f.name: f.dataType for f in sources.schema.fields}

        def of(name: str) -> DataFrame:
            if name in tables:
                return tables[name].select(*head, *schema.columns(name))
            empty = schema.struct_type(name)
            for column in reversed(head):
                empty = type(empty)([type(empty.fields[0])(column, types[column]), *empty.fields])
            return self.spark.createDataFrame([], empty)

        self.tables = MadeOnUse(schema.TABLES, of)
        self.require_compatible()

    # ------------------------------------------------------------------ helpers
    def _save(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, compression="zstd")

    def _allocate(self, table: str) -> Callable[..., DataFrame]:
        return keep_ids(self.tops[table]) if table in self.tops else allocate_ids

    def rows(self, table: str, pk: str | None = None) -> DataFrame:
        """Source rows of a table with their numeric key also as ``pk``."""
        return self.tables[table].withColumn("pk", F.col(pk or schema.primary_key(table)[0]))

    def with_source(self, df: DataFrame) -> DataFrame:
        """Add label and snapshot time of each row's source."""
        info = self.sources.select(
            *self.scope, "src", "label", F.col("LastModified").alias("backup_timestamp"),
            ts_key("LastModified").alias("backup_ts"),
        )
        return df.join(info, [*self.scope, "src"])

    def _ids(self, df: DataFrame, merged_into: Column, conflict: Column | None = None, reason: Column | None = None) -> DataFrame:
        """Id table from rows with ``src, pk, gid`` (gid null = dropped)."""
        none = F.lit(None).cast("string")
        conflict = none if conflict is None else conflict
        kind = F.when(F.col("gid").isNull(), "dropped").when(conflict.isNotNull(), "conflict").otherwise("mapped")
        return df.select(
            *self.scope, "src", F.col("pk").alias("local_id"), F.col("gid").cast("bigint").alias("gid"),
            kind.alias("kind"), F.when(kind == "mapped", merged_into).alias("merged_into"),
            conflict.alias("conflict_id"), (none if reason is None else F.when(kind == "dropped", reason)).alias("reason"),
        )

    def _numeric_lineage(self, table: str, ids: DataFrame) -> DataFrame:
        return ids.select(
            *self.scope, "src", F.lit(table).alias("table"), _text("local_id").alias("local_key"), "kind",
            _text("gid").alias("global_key"), "merged_into", "conflict_id", "reason",
        )

    @cached_property
    def compatibility(self) -> DataFrame:
        return self._save(check_compatibility(self.sources, self.scope), "compatibility")

    def require_compatible(self) -> "Analysis":
        """Raise when any scope has an error, or when there is no source at all."""
        bad = self.compatibility.where("NOT ok")
        if not bad.isEmpty() or self.compatibility.isEmpty():
            raise IncompatibleSources(bad)
        return self

    # ---------------------------------------------------------------- locations
    @cached_property
    def location(self) -> Stage:
        sc = self.scope
        rows = self.rows("Location").withColumns({
            "_t": K.location_place_key(), "_m": K.location_media_key(), "_f": K.location_full_key(),
        })
        matched = self._save(number_entities(match_multi_key(rows, sc, "_t", "_m", "_f"), sc, self._allocate("Location")), "location-ids")
        created = (F.col("src") == F.col("ent_src")) & (F.col("pk") == F.col("ent_pk"))
        columns = [c for c in schema.columns("Location") if c != "LocationId"]
        order = F.struct("src", "pk")
        full = rows.select(*sc, "src", "pk", *columns).join(matched.select(*sc, "src", "pk", "gid"), [*sc, "src", "pk"])
        entity = full.groupBy(*sc, "gid").agg(
            F.min_by(F.struct(*columns), order).alias("r"),
            F.min_by("Title", F.when(~is_blank("Title"), order)).alias("_title"),
        )
        merged = entity.select(
            *sc, F.col("gid").alias("LocationId"),
            *[F.coalesce("_title", "r.Title", F.lit(schema.BLANK_TITLE)).alias("Title") if c == "Title" else F.col(f"r.{c}").alias(c)
              for c in columns],
            (F.col("_title").isNull() & F.col("r.Title").isNull()).alias("title_normalized"),
        )
        return Stage(self._save(merged, "location"), self._ids(matched, ~created), {})

    def describe(self, df: DataFrame, location: str, out: str) -> DataFrame:
        """Add the description of a merged location by its global id."""
        text = self.location.merged.select(
            *self.scope, F.col("LocationId").alias(location), describe_location().alias(out)
        )
        return df.join(text, [*self.scope, location], "left").withColumn(out, F.coalesce(out, F.lit("unknown location")))

    # --------------------------------------------------------------- highlights
    @cached_property
    def _mark_copies(self) -> DataFrame:
        """Every highlight row with its global id; ``loc`` is null for rows that are dropped."""
        rows = self.rows("UserMark").drop("UserMarkId")
        ids = match_or_allocate(rows, self.scope, ["UserMarkGuid"], self._allocate("UserMark")).select(*self.scope, "UserMarkGuid", "gid")
        mapped = remap(rows.join(ids, [*self.scope, "UserMarkGuid"]), self.scope, self.location.ids, "LocationId", "loc")
        return self._save(mapped.drop("LocationId"), "mark-copies")

    @property
    def _mark_ids(self) -> DataFrame:
        """Global ids of the live highlight rows, for references to them; known before their ranges are compared."""
        return self._mark_copies.where("loc IS NOT NULL").select(*self.scope, "src", F.col("pk").alias("local_id"), "gid")

    _RANGE = ["BlockType", "Identifier", "StartToken", "EndToken"]

    @cached_property
    def _mark_ranges(self) -> DataFrame:
        """Ranges of the live highlight copies with the copy they belong to; ``nth`` numbers equal ranges of a copy.

        The numbers are made where ranges meet their copy, so that no later step has to bring equal ranges together for them.
        """
        copy = [*self.scope, "src", "UserMarkId"]
        copies = self._mark_copies.where("loc IS NOT NULL").select(
            *self.scope, "src", F.col("pk").alias("UserMarkId"), "gid"
        )
        held = self.rows("BlockRange").drop("BlockRangeId")
        ranges = held.join(copies, copy)
        if crowded_groups(held, copy, SORTED) is not None:
            ranges = ordinal_within(ranges.withColumn("sig", K.range_key()), [*copy, "gid", "sig"], ["pk"], "nth").drop("sig")
        else:
            ranges = ranges.withColumn("nth", F.row_number().over(Window.partitionBy(*copy, "gid", *self._RANGE).orderBy("pk")).cast("bigint"))
        return self._save(ranges, "mark-ranges")

    @cached_property
    def user_mark(self) -> Stage:
        sc, group = self.scope, [*self.scope, "gid"]
        copies = self._mark_copies.where("loc IS NOT NULL")
        look = F.struct("ColorIndex", "StyleIndex", "Version", "loc")
        groups = copies.groupBy(*group).agg(
            F.count("*").alias("n_copies"), C.agreement(look).alias("_same"),
            F.min(F.struct("src", "pk")).alias("_first"), F.min("UserMarkGuid").alias("guid"),
        )
        # Copies hold equal multisets of ranges iff the n-th occurrence of every range is in all of them.
        per_range = self._mark_ranges.groupBy(*group, *self._RANGE, "nth").agg(F.count("*").alias("_k"))
        per_mark = per_range.groupBy(*group).agg(F.min("_k").alias("_kmin"))
        uneven = F.coalesce("_kmin", "n_copies") != F.col("n_copies")
        groups = self._save(
            groups.join(per_mark, group, "left").select(
                *group, "guid", "n_copies", F.col("_first.src").alias("win_src"), F.col("_first.pk").alias("win_pk"),
                (~F.col("_same") | uneven).alias("is_conflict"),
            ), "mark-groups",
        )
        tagged = self._save(copies.join(groups.select(*group, "is_conflict", "win_src", "win_pk"), group), "mark-tagged")
        is_first = (F.col("src") == F.col("win_src")) & (F.col("pk") == F.col("win_pk"))
        merged = tagged.where(~F.col("is_conflict") & is_first).select(*sc, *self._mark_columns())
        conflict = F.when(F.col("is_conflict"), K.conflict_id("userMark", "UserMarkGuid"))
        live = self._ids(tagged, ~is_first, conflict)
        dropped = self._ids(
            self._mark_copies.where("loc IS NULL").withColumn("gid", F.lit(None)), F.lit(None), None, F.lit("dangling LocationId")
        )
        candidates = self.with_source(tagged.where("is_conflict")).select(
            *sc, conflict.alias("conflict_id"), F.lit("userMark").alias("kind"), F.col("UserMarkGuid").alias("identity_key"),
            "src", "pk", "label", "gid", F.col("backup_timestamp").alias("timestamp"), F.lit("backup").alias("timestamp_source"),
            "backup_timestamp", F.col("backup_ts").alias("row_ts"), "backup_ts", F.col("loc").alias("context_loc"),
            *self._mark_columns(),
        )
        return Stage(merged, live.unionByName(dropped), {"groups": groups, "candidates": candidates})

    @staticmethod
    def _mark_columns() -> list[Column]:
        replaced = {"UserMarkId": "gid", "LocationId": "loc"}
        return [F.col(replaced.get(c, c)).alias(c) for c in schema.columns("UserMark")]

    # -------------------------------------------------------------------- media
    @cached_property
    def media(self) -> Stage:
        sc = self.scope
        rows = self.rows("IndependentMedia")
        matched = self._save(number_entities(match_by_key(rows, sc, "Hash"), sc, self._allocate("IndependentMedia")), "media-ids")
        created = (F.col("src") == F.col("ent_src")) & (F.col("pk") == F.col("ent_pk"))
        full = rows.join(matched, [*sc, "src", "pk"])
        named = self._save(
            rename_collisions(full.where(created).drop("ent_src", "ent_pk"), sc), "media-named"
        )
        merged = named.select(
            *sc, F.col("gid").alias("IndependentMediaId"), "OriginalFilename", F.col("new_path").alias("FilePath"),
            "MimeType", "Hash", "renamed", "src", "pk",
        )
        paths = full.join(named.select(*sc, "gid", "new_path"), [*sc, "gid"]).select(
            *sc, "src", "pk", "gid", "FilePath", "new_path", created.alias("created"), "OriginalFilename"
        )
        return Stage(
            merged, self._ids(matched, ~created), {"paths": self._save(paths, "media-paths")},
        )

    @cached_property
    def collected_media(self) -> DataFrame:
        """For each merged media path, the first source that really has the file.

        ``[*scope, gid, FilePath, src, path]``; ``created_without_file`` rows are warned about.
        """
        sc = self.scope
        held = self.media.extra["paths"].join(
            self._files().select(*sc, "src", F.col("path").alias("FilePath")), [*sc, "src", "FilePath"]
        )
        first = held.groupBy(*sc, "gid").agg(
            F.min_by(F.struct("src", "FilePath"), F.struct("src", "pk")).alias("f"), F.first("new_path").alias("new_path")
        )
        return first.select(*sc, "gid", F.col("new_path").alias("FilePath"), F.col("f.src").alias("src"), F.col("f.FilePath").alias("path"))

    def _files(self) -> DataFrame:
        if self.media_files is not None:
            return self.media_files
        types = {f.name: f.dataType for f in self.sources.schema.fields}
        fields = [f"{c} {types[c].simpleString()}" for c in [*self.scope, "src"]]
        return self.spark.createDataFrame([], ", ".join([*fields, "path string", "content binary"]))

    # ------------------------------------------------------------------- ranges
    @cached_property
    def block_range(self) -> Stage:
        sc = self.scope
        groups = self.user_mark.extra["groups"].select(
            *sc, "gid", F.when(F.col("is_conflict"), F.col("guid")).alias("guid"), "is_conflict", "n_copies", "win_src", "win_pk"
        )
        ranges = self._mark_ranges.withColumnRenamed("gid", "mark").join(
            groups.withColumnRenamed("gid", "mark"), [*sc, "mark"]
        )
        is_winner = (F.col("src") == F.col("win_src")) & (F.col("UserMarkId") == F.col("win_pk"))
        ranges = ranges.withColumn("is_winner", is_winner)
        emitted = ranges.where("is_conflict OR is_winner").select(
            *sc, "src", "pk", "UserMarkId", "mark", "guid", "is_conflict", *self._RANGE, "nth", (F.col("n_copies") > 1).alias("_shared"),
        )
        kept = self._allocate("BlockRange")(emitted, sc, ["mark", "src", "UserMarkId", "pk"])
        if sc or self.tops:  # numbers over a whole table are read off the stage table of its sort
            kept = self._save(kept, "range-kept")
        conflict = F.when(F.col("is_conflict"), K.conflict_id("userMark", "guid"))
        kept_ids = self._ids(kept, F.lit(False), conflict)
        # Ranges of further agreeing copies pair with the winner's by (range, n-th occurrence).
        sig = K.range_key().alias("sig")
        others = ranges.where("NOT is_conflict AND NOT is_winner").select(*sc, "src", "pk", "mark", sig, "nth")
        pool = kept.where("NOT is_conflict AND _shared").select(*sc, "mark", sig, "nth", "gid")
        paired = self._ids(others.join(pool, [*sc, "mark", "sig", "nth"], "left"), F.lit(True), None, F.lit("unpaired duplicate"))
        orphans = self.rows("BlockRange").join(
            self._mark_copies.where("loc IS NOT NULL").select(*sc, "src", F.col("pk").alias("UserMarkId")),
            [*sc, "src", "UserMarkId"], "left_anti",
        ).withColumn("gid", F.lit(None).cast("bigint"))
        lost = self._ids(orphans, F.lit(None), None, F.lit("dangling UserMarkId"))
        replaced = {"BlockRangeId": "gid", "UserMarkId": "mark"}
        columns = [F.col(replaced.get(c, c)).alias(c) for c in schema.columns("BlockRange")]
        merged = kept.where("NOT is_conflict").select(*sc, *columns)
        children = kept.where("is_conflict").select(
            *sc, conflict.alias("conflict_id"), "src", F.col("UserMarkId").alias("mark_pk"), F.col("pk").alias("range_pk"), *columns
        )
        ids = kept_ids.unionByName(paired).unionByName(lost)
        return Stage(merged, ids, {"children": children})

    # -------------------------------------------------------------------- notes
    @cached_property
    def _note_copies(self) -> DataFrame:
        """Slim note rows: global id, remapped links, time key, digest of the normal text."""
        sc = self.scope
        text = K.key_of(normalize_text("Title"), normalize_text("Content"))
        slim = self.rows("Note").select(
            *sc, "src", "pk", "Guid", "UserMarkId", "LocationId", "LastModified", F.sha2(text, 256).alias("sig")
        )
        ids = match_or_allocate(slim.select(*sc, "src", "pk", "Guid"), sc, ["Guid"], self._allocate("Note")).select(*sc, "Guid", "gid")
        copies = slim.join(ids, [*sc, "Guid"])
        copies = remap(copies, sc, self._mark_ids, "UserMarkId", "mark")
        copies = remap(copies, sc, self.location.ids, "LocationId", "loc")
        return self._save(copies.withColumn("row_ts", ts_key("LastModified")), "note-copies")

    @cached_property
    def note(self) -> Stage:
        sc, group = self.scope, [*self.scope, "gid"]
        copies = self._note_copies
        groups = copies.groupBy(*group).agg(C.agreement("sig").alias("_same"), F.count("*").alias("n_copies")).join(
            C.latest_copy(copies, group, "row_ts"), group
        )
        tagged = self._save(copies.join(groups, group), "note-tagged")
        wins = (F.col("src") == F.col("win_src")) & (F.col("pk") == F.col("win_pk"))
        conflict = F.when(~F.col("_same"), K.conflict_id("note", "Guid"))
        ids = self._ids(tagged, ~wins, conflict)
        texts = self.rows("Note").select(*sc, "src", "pk", "Title", "Content", "Created", "BlockType", "BlockIdentifier")
        chosen = tagged.where(~F.col("_same") | wins).join(texts, [*sc, "src", "pk"])
        replaced = {"NoteId": "gid", "UserMarkId": "mark", "LocationId": "loc"}
        columns = [F.col(replaced.get(c, c)).alias(c) for c in schema.columns("Note")]
        merged = chosen.where("_same").select(*sc, *columns)
        candidates = self.with_source(chosen.where("NOT _same")).select(
            *sc, conflict.alias("conflict_id"), F.lit("note").alias("kind"), F.col("Guid").alias("identity_key"), "src", "pk",
            "label", "gid", F.col("LastModified").alias("timestamp"), F.lit("row").alias("timestamp_source"), "backup_timestamp",
            "row_ts", "backup_ts", F.col("loc").alias("context_loc"), *columns,
        )
        return Stage(merged, ids, {"candidates": candidates})

    # ---------------------------------------------------------------- bookmarks
    @cached_property
    def bookmark(self) -> Stage:
        sc = self.scope
        rows = remap(self.rows("Bookmark"), sc, self.location.ids, "PublicationLocationId", "pub")
        rows = self._save(remap(rows, sc, self.location.ids, "LocationId", "loc"), "bookmark-copies")
        live = rows.where("pub IS NOT NULL AND loc IS NOT NULL").withColumn("target", K.bookmark_target_key("pub", "loc"))
        matched = self._save(number_entities(match_by_key(live, sc, "target"), sc, self._allocate("Bookmark")), "bookmark-ids")
        created = (F.col("src") == F.col("ent_src")) & (F.col("pk") == F.col("ent_pk"))
        new = live.join(matched.where(created).select(*sc, "src", "pk", "gid"), [*sc, "src", "pk"])
        placed = self._save(fill_slots(new.drop("target"), [*sc, "pub"]), "bookmark-slots")
        replaced = {"BookmarkId": "gid", "PublicationLocationId": "pub", "LocationId": "loc", "Slot": "new_slot"}
        merged = placed.select(
            *sc, *[F.col(replaced.get(c, c)).alias(c) for c in schema.columns("Bookmark")],
            F.col("Slot").alias("own_slot"), "src", "pk",
        )
        dropped = rows.where("pub IS NULL OR loc IS NULL").withColumn("gid", F.lit(None))
        ids = self._ids(matched, ~created).unionByName(
            self._ids(dropped, F.lit(None), None, F.lit("dangling LocationId"))
        )
        return Stage(merged, ids, {})

    # ------------------------------------------------------------- input fields
    @cached_property
    def input_field(self) -> Stage:
        sc, group = self.scope, [*self.scope, "loc", "TextTag"]
        rows = remap(self.rows("InputField"), sc, self.location.ids, "LocationId", "loc")
        rows = self._save(
            self.with_source(rows).withColumn("sig", normalize_text("Value")), "field-copies"
        )
        live = rows.where("loc IS NOT NULL")
        groups = live.groupBy(*group).agg(C.agreement("sig").alias("_same")).join(
            C.latest_copy(live, group, "backup_ts"), group
        )
        tagged = self._save(live.join(groups, group), "field-tagged")
        wins = (F.col("src") == F.col("win_src")) & (F.col("pk") == F.col("win_pk"))
        identity = K.input_field_key("loc")
        conflict = F.when(~F.col("_same"), K.conflict_id("inputField", identity))
        columns = [F.col("loc").alias("LocationId"), "TextTag", "Value"]
        merged = tagged.where(F.col("_same") & wins).select(*sc, *columns)
        lineage = tagged.select(
            *sc, "src", F.lit("InputField").alias("table"), K.local_key("InputField").alias("local_key"),
            F.when(F.col("_same"), "mapped").otherwise("conflict").alias("kind"), identity.alias("global_key"),
            F.when(F.col("_same"), ~wins).alias("merged_into"), conflict.alias("conflict_id"),
            F.lit(None).cast("string").alias("reason"),
        ).unionByName(self._composite_dropped(rows.where("loc IS NULL"), "InputField", "dangling LocationId"))
        candidates = tagged.where("NOT _same").select(
            *sc, conflict.alias("conflict_id"), F.lit("inputField").alias("kind"), identity.alias("identity_key"), "src", "pk",
            "label", F.col("loc").alias("gid"), F.col("backup_timestamp").alias("timestamp"),
            F.lit("backup").alias("timestamp_source"), "backup_timestamp", F.col("backup_ts").alias("row_ts"), "backup_ts",
            F.col("loc").alias("context_loc"), *columns,
        )
        return Stage(merged, lineage, {"candidates": candidates})

    def _composite_dropped(self, df: DataFrame, table: str, reason: str) -> DataFrame:
        none = F.lit(None)
        return df.select(
            *self.scope, "src", F.lit(table).alias("table"), K.local_key(table).alias("local_key"),
            F.lit("dropped").alias("kind"), none.cast("string").alias("global_key"), none.cast("boolean").alias("merged_into"),
            none.cast("string").alias("conflict_id"), F.lit(reason).alias("reason"),
        )

    # --------------------------------------------------------- tags, accuracies
    def _merge_by_name(self, table: str, key: list[str], name: str) -> Stage:
        sc = self.scope
        rows = self.rows(table)
        entities = match_or_allocate(rows, sc, key, self._allocate(table))
        joined = self._save(rows.join(entities, [*sc, *key]), name)
        created = (F.col("src") == F.col("ent_src")) & (F.col("pk") == F.col("ent_pk"))
        pk = schema.primary_key(table)[0]
        merged = joined.where(created).select(
            *sc, *[F.col("gid").alias(c) if c == pk else F.col(c) for c in schema.columns(table)]
        )
        return Stage(merged, self._ids(joined, ~created), {"rows": joined.withColumn("created", created)})

    @cached_property
    def tag(self) -> Stage:
        return self._merge_by_name("Tag", ["Type", "Name"], "tag")

    @cached_property
    def accuracy(self) -> Stage:
        return self._merge_by_name("PlaylistItemAccuracy", ["Description"], "accuracy")

    # ----------------------------------------------------------- playlist items
    @cached_property
    def _item_locations(self) -> DataFrame:
        rows = self.tables["PlaylistItemLocationMap"]
        return self._save(remap(rows, self.scope, self.location.ids, "LocationId", "loc"), "item-locations")

    @cached_property
    def _item_media(self) -> DataFrame:
        head = [*self.scope, "src"]
        hashes = self.tables["IndependentMedia"].select(*head, "IndependentMediaId", "Hash")
        rows = self.tables["PlaylistItemIndependentMediaMap"].join(hashes, [*head, "IndependentMediaId"], "left")
        return self._save(remap(rows, self.scope, self.media.ids, "IndependentMediaId", "med"), "item-media")

    @cached_property
    def _items(self) -> DataFrame:
        """Items with their structural signature; equal signatures mean the same item."""
        sc, head = self.scope, [*self.scope, "src"]
        t = self.tables
        rows = self.rows("PlaylistItem")
        descriptions = t["PlaylistItemAccuracy"].select(
            *head, F.col("PlaylistItemAccuracyId").alias("Accuracy"), F.col("Description").alias("_accuracy")
        )
        # Of several media with one path in a source the last one is meant, as when a path is looked up.
        thumbs = t["IndependentMedia"].groupBy(*head, F.col("FilePath").alias("ThumbnailFilePath")).agg(F.max_by("Hash", "IndependentMediaId").alias("_thumb"))
        item = [*head, "PlaylistItemId"]
        unknown = lambda gid, raw: F.coalesce(_text(gid), F.concat(F.lit("?"), F.col(raw)))
        places = self._item_locations.groupBy(*item).agg(
            K.multiset_key(K.key_of(unknown("loc", "LocationId"), "MajorMultimediaType", "BaseDurationTicks")).alias("_places")
        )
        media = self._item_media.groupBy(*item).agg(
            K.multiset_key(K.key_of(unknown("Hash", "IndependentMediaId"), "DurationTicks")).alias("_media")
        )
        marker = [*head, "PlaylistItemMarkerId"]
        verses = t["PlaylistItemMarkerBibleVerseMap"].groupBy(*marker).agg(
            K.multiset_key(_text("VerseId")).alias("_verses")
        )
        paragraphs = t["PlaylistItemMarkerParagraphMap"].groupBy(*marker).agg(
            K.multiset_key(K.key_of("MepsDocumentId", "ParagraphIndex", "MarkerIndexWithinParagraph")).alias("_paragraphs")
        )
        markers = (
            t["PlaylistItemMarker"].join(verses, marker, "left").join(paragraphs, marker, "left").groupBy(*item).agg(
                K.multiset_key(
                    K.key_of("Label", "StartTimeTicks", "DurationTicks", "EndTransitionDurationTicks", "_verses", "_paragraphs")
                ).alias("_markers")
            )
        )
        joined = (
            rows.join(descriptions, [*head, "Accuracy"], "left").join(thumbs, [*head, "ThumbnailFilePath"], "left")
            .join(places, item, "left").join(media, item, "left").join(markers, item, "left")
        )
        signature = F.sha2(
            K.key_of("Label", "StartTrimOffsetTicks", "EndTrimOffsetTicks", "EndAction", "_accuracy", "_thumb",
                     "_places", "_media", "_markers"), 256,
        )
        slim = joined.withColumn("sig", signature).drop("_places", "_media", "_markers", "_thumb", "_accuracy")
        slim = remap(slim, sc, self.accuracy.ids, "Accuracy", "acc")
        paths = self.media.extra["paths"].groupBy(*head, F.col("FilePath").alias("ThumbnailFilePath")).agg(
            F.max_by("new_path", "pk").alias("thumb_path")
        )
        return self._save(slim.join(paths, [*head, "ThumbnailFilePath"], "left"), "items")

    @cached_property
    def playlist_item(self) -> Stage:
        sc = self.scope
        live = self._items.where("acc IS NOT NULL")
        matched = self._save(number_entities(match_by_key(live, sc, "sig"), sc, self._allocate("PlaylistItem")), "item-ids")
        created = (F.col("src") == F.col("ent_src")) & (F.col("pk") == F.col("ent_pk"))
        new = live.join(matched.where(created).select(*sc, "src", "pk", "gid"), [*sc, "src", "pk"])
        replaced = {"PlaylistItemId": "gid", "Accuracy": "acc", "ThumbnailFilePath": "thumb_path"}
        merged = new.select(*sc, *[F.col(replaced.get(c, c)).alias(c) for c in schema.columns("PlaylistItem")])
        dropped = self._items.where("acc IS NULL").withColumn("gid", F.lit(None))
        ids = self._ids(matched, ~created).unionByName(self._ids(dropped, F.lit(None), None, F.lit("dangling Accuracy")))
        return Stage(merged, ids, {})

    def _item_children(self, rows: DataFrame) -> DataFrame:
        """Child rows with the fate of their item: ``item`` (null = dropped) and ``owns``."""
        fate = self.playlist_item.ids.select(
            *self.scope, "src", F.col("local_id").alias("PlaylistItemId"), F.col("gid").alias("item"),
            (F.coalesce(F.col("merged_into"), F.lit(True)) == F.lit(False)).alias("owns"),
        )
        return rows.join(fate, [*self.scope, "src", "PlaylistItemId"])

    def _child_lineage(self, df: DataFrame, table: str, reason: Column) -> DataFrame:
        """Lineage of child rows with ``global_key`` (null = dropped) and ``merged_into``."""
        found = F.col("global_key").isNotNull()
        return df.select(
            *self.scope, "src", F.lit(table).alias("table"), K.local_key(table).alias("local_key"),
            F.when(found, "mapped").otherwise("dropped").alias("kind"), "global_key",
            F.when(found, F.col("merged_into")).alias("merged_into"),
            F.lit(None).cast("string").alias("conflict_id"), F.when(~found, reason).alias("reason"),
        )

    @staticmethod
    def _child_reason(own: str) -> Column:
        return (
            F.when(F.col("item").isNull(), "parent playlist item dropped")
            .when(F.col("owns"), own).otherwise("no matching child on the winning copy")
        )

    def _linked(self, rows: DataFrame, table: str, ref: str, content: list[str], trace: list[Column], own_reason: str,
                name: str) -> Stage:
        """Item links (locations or media): first link per target of an owning item, others traced.

        ``content`` are the kept columns, ``trace`` the signature a merged item's link is found by.
        """
        sc = self.scope
        local = schema.primary_key(table)[1]
        rows = self._save(self._item_children(rows).withColumn("_trace", K.key_of(*trace)), name)
        own = rows.where(F.col("owns") & F.col(ref).isNotNull())
        first = self._save(own.groupBy(*sc, "item", ref).agg(
            F.min_by(F.struct(*content, "_trace", local), F.col(local)).alias("r")
        ), f"{name}-first")
        merged = first.select(
            *sc, F.col("item").alias("PlaylistItemId"), F.col(ref).alias(local), *[F.col(f"r.{c}").alias(c) for c in content]
        )
        key = K.key_of("item", ref)
        owned = rows.where("owns").join(
            first.select(*sc, "item", ref, F.col(f"r.{local}").alias("_kept")), [*sc, "item", ref], "left"
        ).withColumn("global_key", F.when(F.col(ref).isNotNull(), key)).withColumn(
            "merged_into", F.col("_kept") != F.col(local)
        )
        traces = first.groupBy(*sc, "item", F.col("r._trace").alias("_trace")).agg(
            F.max_by(key, F.col(f"r.{local}")).alias("global_key")
        )
        traced = rows.where("NOT owns").join(traces, [*sc, "item", "_trace"], "left").withColumn("merged_into", F.lit(True))
        reason = self._child_reason(own_reason)
        lineage = self._child_lineage(owned, table, reason).unionByName(self._child_lineage(traced, table, reason))
        return Stage(merged, lineage, {})

    @cached_property
    def item_location(self) -> Stage:
        return self._linked(
            self._item_locations, "PlaylistItemLocationMap", "loc", ["MajorMultimediaType", "BaseDurationTicks"],
            [F.col("loc"), F.col("MajorMultimediaType"), F.col("BaseDurationTicks")], "dangling LocationId", "item-location",
        )

    @cached_property
    def item_media(self) -> Stage:
        return self._linked(
            self._item_media, "PlaylistItemIndependentMediaMap", "med", ["DurationTicks"],
            [F.col("Hash"), F.col("DurationTicks")], "dangling IndependentMediaId", "item-media-link",
        )

    @cached_property
    def marker(self) -> Stage:
        sc = self.scope
        rows = self._save(self._item_children(self.rows("PlaylistItemMarker")), "marker-copies")
        own = rows.where("owns")
        first = own.groupBy(*sc, "item", "StartTimeTicks").agg(
            F.min_by(F.struct("Label", "DurationTicks", "EndTransitionDurationTicks", "src", "pk"), F.col("pk")).alias("r")
        ).select(*sc, "item", "StartTimeTicks", "r.*")
        kept = self._save(self._allocate("PlaylistItemMarker")(first, sc, ["item", "pk"]), "marker-kept")
        replaced = {"PlaylistItemMarkerId": "gid", "PlaylistItemId": "item"}
        merged = kept.select(*sc, *[F.col(replaced.get(c, c)).alias(c) for c in schema.columns("PlaylistItemMarker")])
        starts = kept.select(*sc, "item", "StartTimeTicks", "gid", F.col("pk").alias("_kept"))
        traced = self._save(rows.join(starts, [*sc, "item", "StartTimeTicks"], "left"), "marker-traced")
        folded = ~F.col("owns") | (F.col("pk") != F.col("_kept"))
        ids = self._ids(traced, folded, None, self._child_reason("repeated start time"))
        # Details are carried for the kept marker of an owning item and traced for merged items;
        # a repeated marker of an owning item folds away together with its details.
        carriers = traced.where("NOT owns OR pk = _kept").select(
            *sc, "src", F.col("pk").alias("PlaylistItemMarkerId"), F.col("gid").alias("mark"), "item", "owns"
        )
        return Stage(merged, ids, {"carriers": carriers})

    def _details(self, table: str) -> Stage:
        sc = self.scope
        rest = schema.primary_key(table)[1:]
        rows = self.tables[table].join(self.marker.extra["carriers"], [*sc, "src", "PlaylistItemMarkerId"])
        merged = rows.where("owns").select(*sc, F.col("mark").alias("PlaylistItemMarkerId"), *rest).distinct()
        keyed = rows.withColumn("global_key", F.when(F.col("mark").isNotNull(), K.key_of("mark", *rest))).withColumn(
            "merged_into", ~F.col("owns")
        )
        return Stage(merged, self._child_lineage(keyed, table, self._child_reason("")), {})

    @cached_property
    def marker_verse(self) -> Stage:
        return self._details("PlaylistItemMarkerBibleVerseMap")

    @cached_property
    def marker_paragraph(self) -> Stage:
        return self._details("PlaylistItemMarkerParagraphMap")

    # ---------------------------------------------------------- tag assignments
    @cached_property
    def tag_map(self) -> Stage:
        sc = self.scope
        rows = self.rows("TagMap")
        ranks = rows.groupBy(*sc, "src", "TagId").agg(F.min("pk").alias("tag_rank"))
        rows = remap(rows.join(ranks, [*sc, "src", "TagId"]), sc, self.tag.ids, "TagId", "tag")
        targets = [("N", "NoteId", self.note.ids), ("L", "LocationId", self.location.ids), ("P", "PlaylistItemId", self.playlist_item.ids)]
        rows = self._save(remap_any(rows, sc, targets), "assignment-copies")
        owner = rows.where("tag IS NOT NULL").groupBy(*sc, "tag").agg(F.min(F.struct("src", "tag_rank")).alias("_owner"))
        live = rows.where("tag IS NOT NULL AND ref IS NOT NULL")
        order = ["src", "tag_rank", "Position", "pk"]
        first = live.groupBy(*sc, "tag", "kind", "ref").agg(F.min(F.struct(*order)).alias("_first"))
        new = first.select(*sc, "tag", "kind", "ref", "_first.*").join(owner, [*sc, "tag"]).withColumn(
            "first_contributor", (F.col("src") == F.col("_owner.src")) & (F.col("tag_rank") == F.col("_owner.tag_rank"))
        ).drop("_owner")
        placed = append_positions(self._save(new, "assignments-new"), [*sc, "tag"], order)
        kept = self._save(self._allocate("TagMap")(placed, sc, order), "assignments")
        target = lambda kind: F.when(F.col("kind") == kind, F.col("ref"))
        merged = kept.select(
            *sc, F.col("gid").alias("TagMapId"), target("P").alias("PlaylistItemId"), target("L").alias("LocationId"),
            target("N").alias("NoteId"), F.col("tag").alias("TagId"), F.col("new_position").alias("Position"),
            F.col("Position").alias("own_position"), "src", "pk",
        )
        winners = kept.select(*sc, "tag", "kind", "ref", "gid", F.col("src").alias("_s"), F.col("pk").alias("_p"))
        mapped = live.join(winners, [*sc, "tag", "kind", "ref"])
        into = (F.col("src") != F.col("_s")) | (F.col("pk") != F.col("_p"))
        lost = rows.where("tag IS NULL OR ref IS NULL").withColumn("gid", F.lit(None))
        reason = F.when(F.col("tag").isNull(), "dangling TagId").otherwise("dangling reference in source")
        ids = self._ids(mapped, into).unionByName(self._ids(lost, F.lit(None), None, reason))
        return Stage(merged, ids, {"copies": rows})

    # ------------------------------------------------------------------ results
    STAGES = {
        "Location": "location", "UserMark": "user_mark", "IndependentMedia": "media", "BlockRange": "block_range",
        "Note": "note", "Bookmark": "bookmark", "InputField": "input_field", "Tag": "tag",
        "PlaylistItemAccuracy": "accuracy", "PlaylistItem": "playlist_item",
        "PlaylistItemLocationMap": "item_location", "PlaylistItemIndependentMediaMap": "item_media",
        "PlaylistItemMarker": "marker", "PlaylistItemMarkerBibleVerseMap": "marker_verse",
        "PlaylistItemMarkerParagraphMap": "marker_paragraph", "TagMap": "tag_map",
    }

    def stage(self, table: str) -> Stage:
        return getattr(self, self.STAGES[table])

    def merged(self, table: str) -> DataFrame:
        """Non-conflicting merged rows of a table."""
        return self.stage(table).merged.select(*self.scope, *schema.columns(table))

    def lineage_of(self, table: str) -> DataFrame:
        ids = self.stage(table).ids
        flat = ids if "local_key" in ids.columns else self._numeric_lineage(table, ids)
        return flat.select(*self.scope, "src", *LINEAGE)

    @cached_property
    def lineage(self) -> DataFrame:
        """Fate of every source row: mapped, conflict or dropped."""
        return reduce(DataFrame.unionByName, [self.lineage_of(t) for t in schema.TABLES])

    @cached_property
    def candidates(self) -> DataFrame:
        """All conflict candidates with the columns the three kinds share."""
        return reduce(DataFrame.unionByName, [self.candidates_of(kind) for kind in ("userMark", "note", "inputField")])

    def candidates_of(self, kind: str) -> DataFrame:
        """``candidates`` of one kind."""
        shared = [*self.scope, "conflict_id", "kind", "identity_key", "src", "pk", "label", "gid", "timestamp",
                  "timestamp_source", "backup_timestamp", "row_ts", "backup_ts", "context_loc"]
        return getattr(self, self.CONFLICTS[kind][0]).extra["candidates"].select(*shared)

    #: Conflicts by kind: the stage that finds them, and whether their rows carry a time of their own.
    CONFLICTS = {"note": ("note", True), "userMark": ("user_mark", False), "inputField": ("input_field", False)}
    #: Tables whose rows can be in conflict, with the kind of those conflicts.
    KINDS = {"Note": "note", "UserMark": "userMark", "InputField": "inputField"}

    @cached_property
    def conflicts(self) -> DataFrame:
        """One row per conflict: kind, suggestion with its reason, context line."""
        return reduce(DataFrame.unionByName, [self.conflicts_of(kind) for kind in self.CONFLICTS])

    def conflicts_of(self, kind: str) -> DataFrame:
        """``conflicts`` of one kind, made from the stage of that kind alone."""
        if kind not in self._conflicts:
            self._conflicts[kind] = self._save(self._described_conflicts(kind), f"conflicts-{kind}")
        return self._conflicts[kind]

    def _described_conflicts(self, kind: str) -> DataFrame:
        group = [*self.scope, "conflict_id"]
        stage, by_row = self.CONFLICTS[kind]
        slim = getattr(self, stage).extra["candidates"].select(
            *group, "kind", "identity_key", "gid", "src", "pk", "label", "row_ts", "backup_ts", "context_loc")
        about = slim.groupBy(*group).agg(
            F.first("kind").alias("kind"), F.first("identity_key").alias("identity_key"), F.first("gid").alias("gid"),
            F.min_by("context_loc", F.when(F.col("context_loc").isNotNull(), F.struct("src", "pk"))).alias("context_loc"),
        )
        described = self.describe(about.join(C.suggest_winner(slim, group, by_row), group), "context_loc", "_where")
        field = F.element_at(F.split("identity_key", K.KEY_SEPARATOR), 2)
        context = (
            F.when(F.col("context_loc").isNull(), "note without a location")
            .when(F.col("kind") == "inputField", F.concat(F.col("_where"), F.lit(' · field "'), field, F.lit('"')))
            .otherwise(F.col("_where"))
        )
        return described.withColumn("context", context).drop("_where", "context_loc")
