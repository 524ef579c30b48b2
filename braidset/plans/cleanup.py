"""Opt-in clean-ups of merged tables; each sees the output of the one before."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from braidset import schema
from braidset.functions import keys as K
from braidset.functions.text import is_empty_note
from braidset.operators.remap import referenced, unreferenced
from braidset.session import materialize

# Clean-ups in the order they run, with their defaults.
DEFAULTS = {
    "emptyNotes": False,
    "rangelessHighlights": True,
    "duplicateHighlights": True,
    "unusedMedia": True,
    "emptyPlaylists": False,
    "unreferencedLocations": True,
}

# The table each clean-up removes rows from.
CLEANED_TABLE = {
    "emptyNotes": "Note",
    "rangelessHighlights": "UserMark",
    "duplicateHighlights": "UserMark",
    "unusedMedia": "IndependentMedia",
    "emptyPlaylists": "Tag",
    "unreferencedLocations": "Location",
}


class Changed(Mapping):
    """Tables that clean-ups changed, as the last of them left them; each is written when it is first read."""

    def __init__(self, scope: list[str]) -> None:
        self.scope, self.drafts, self._written = scope, {}, {}

    def put(self, table: str, df: DataFrame) -> None:
        self.drafts[table] = df.select(*self.scope, *schema.columns(table))
        self._written.pop(table, None)

    def slim(self, table: str) -> DataFrame:
        """The table for readers of few columns, which does not have to be written for them."""
        return self._written.get(table, self.drafts[table])

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._written:
            self._written[table] = materialize(self.drafts[table], f"clean-{table}")
        return self._written[table]

    def __contains__(self, table: object) -> bool:
        return table in self.drafts

    def __iter__(self) -> Iterator[str]:
        return iter(self.drafts)

    def __len__(self) -> int:
        return len(self.drafts)


@dataclass
class Cleaned:
    """Cleaned tables and, per clean-up, the ids it acted on (``[*scope, id]``).

    ``changed`` are the tables that clean-ups changed; all others are those from before. Each is made when it is first asked for.
    """

    changed: Changed
    before: Mapping[str, DataFrame]
    scope: list[str]
    acted: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def tables(self) -> Mapping[str, DataFrame]:
        return ChainMap(self.changed, self.before)

    def summary(self) -> DataFrame:
        """Rows per action: ``[*scope, action, n]``, actions without rows left out."""
        parts = [
            ids.groupBy(*self.scope).agg(F.count("*").alias("n")).select(*self.scope, F.lit(name).alias("action"), "n")
            for name, ids in self.acted.items()
        ]
        if not parts:
            empty = self.tables["Tag"].select(*self.scope, F.lit("").alias("action"), F.lit(0).cast("bigint").alias("n"))
            return empty.where(F.lit(False))
        return reduce(DataFrame.unionByName, parts).where("n > 0")

    def removed(self) -> DataFrame:
        """Rows removed per table: ``[*scope, table, removed]``, only tables that lost rows."""
        parts = []
        for name in (n for n in schema.TABLES if n in self.changed):
            pk = schema.primary_key(name)
            gone = self.before[name].join(self.changed.slim(name), [*self.scope, *pk], "left_anti")
            parts.append(gone.groupBy(*self.scope).agg(F.count("*").alias("removed")).select(
                *self.scope, F.lit(name).alias("table"), "removed"
            ))
        if not parts:
            return self.tables["Tag"].select(*self.scope, F.lit("").alias("table"), F.lit(0).cast("bigint").alias("removed")).where(F.lit(False))
        return reduce(DataFrame.unionByName, parts).where("removed > 0")


def location_references(tables: dict[str, DataFrame]) -> list[tuple[DataFrame, str]]:
    """Every column that can mention a location."""
    return [(tables[child], column) for child, column, parent, _ in schema.FOREIGN_KEYS if parent == "Location"]


def remove_empty_notes(t: dict, scope: list[str]) -> tuple[dict, dict]:
    empty = t["Note"].where(is_empty_note())
    gone = materialize(unreferenced(empty, scope, "NoteId", (t["TagMap"], "NoteId")).select(*scope, "NoteId"), "gone-notes")
    return {"Note": t["Note"].join(gone, [*scope, "NoteId"], "left_anti")}, {"emptyNotes": gone}


def remove_rangeless_marks(t: dict, scope: list[str]) -> tuple[dict, dict]:
    key = [*scope, "UserMarkId"]
    gone = materialize(unreferenced(t["UserMark"], scope, "UserMarkId", (t["BlockRange"], "UserMarkId")).select(*key), "gone-marks")
    notes = t["Note"].join(gone.withColumn("_gone", F.lit(True)), key, "left")
    detached = F.coalesce("_gone", F.lit(False))
    return {
        "UserMark": t["UserMark"].join(gone, key, "left_anti"),
        "Note": notes.withColumn("UserMarkId", F.when(~detached, F.col("UserMarkId"))).drop("_gone"),
    }, {"rangelessHighlights": gone, "notesDetached": notes.where(detached).select(*scope, "NoteId")}


def duplicate_groups(t: dict, scope: list[str]) -> DataFrame:
    """Highlights that have ranges, with ``ranges``: equal for those of one place that hold the same ranges equally often.

    Ranges are first compared by their fingerprint. Where highlights of one place share it, their ranges are counted one by one; a
    group that only met by chance is told apart by the ranges themselves.
    """
    key = [*scope, "UserMarkId"]
    parts = ["BlockType", "Identifier", "StartToken", "EndToken"]
    ranges = t["BlockRange"].select(*key, *parts)
    prints = ranges.groupBy(*key).agg(K.multiset_key(K.range_key()).alias("ranges"))
    marks = materialize(t["UserMark"].join(prints, key), "mark-prints", compression="zstd")
    group = [*scope, "LocationId", "ranges"]
    sizes = marks.groupBy(*group).agg(F.count("*").alias("_marks")).where("_marks > 1")
    # Few highlights share one as a rule; as a table their number is known where all ranges would have to move to them.
    shared = materialize(marks.select(*key, "LocationId", "ranges").join(sizes, group), "shared-prints")
    per_mark = ranges.join(shared, key).groupBy(*group, "_marks", *parts, *[c for c in key if c not in scope]).agg(F.count("*").alias("_c"))
    per_range = per_mark.groupBy(*group, "_marks", *parts).agg(F.count("*").alias("_held"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    unlike = per_range.where("_held <> _marks OR _lo <> _hi").select(*group).distinct()
    mixed = materialize(shared.join(unlike, group, "left_semi").select(*key), "unlike-marks")
    own = ranges.join(mixed, key).groupBy(*key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(K.range_key())), "\n"), 256).alias("_exact"))
    told = marks.join(own, key, "left").withColumn("ranges", F.concat_ws("/", "ranges", "_exact"))
    return told.drop("_exact")


def merge_duplicate_marks(t: dict, scope: list[str]) -> tuple[dict, dict]:
    """Same place, look and ranges: keep the one with most notes, then the lowest id."""
    key = [*scope, "UserMarkId"]
    notes_per = t["Note"].where("UserMarkId IS NOT NULL").groupBy(*key).agg(F.count("*").alias("_notes"))
    marks = duplicate_groups(t, scope).join(notes_per, key, "left")
    same = [*scope, "LocationId", "ColorIndex", "StyleIndex", "ranges"]
    keeper = marks.groupBy(*same).agg(
        F.max_by("UserMarkId", F.struct(F.coalesce("_notes", F.lit(0)), -F.col("UserMarkId"))).alias("keeper"),
        F.count("*").alias("_size"),
    ).where("_size > 1")
    moved = marks.join(keeper, same).where("UserMarkId <> keeper").select(*key, "keeper")
    moved = materialize(moved, "duplicate-marks")
    notes = t["Note"].join(moved, key, "left")
    return {
        "UserMark": t["UserMark"].join(moved, key, "left_anti"),
        "BlockRange": t["BlockRange"].join(moved, key, "left_anti"),
        "Note": notes.withColumn("UserMarkId", F.coalesce("keeper", "UserMarkId")).drop("keeper"),
    }, {"duplicateHighlights": moved.select(*key), "notesReattached": notes.where("keeper IS NOT NULL").select(*scope, "NoteId")}


def remove_unused_media(t: dict, scope: list[str]) -> tuple[dict, dict]:
    unlinked = unreferenced(t["IndependentMedia"], scope, "IndependentMediaId", (t["PlaylistItemIndependentMediaMap"], "IndependentMediaId"))
    gone = materialize(
        unreferenced(unlinked, scope, "FilePath", (t["PlaylistItem"], "ThumbnailFilePath")).select(*scope, "IndependentMediaId", "FilePath"),
        "gone-media",
    )
    kept = t["IndependentMedia"].join(gone, [*scope, "IndependentMediaId"], "left_anti")
    return {"IndependentMedia": kept}, {"unusedMedia": gone}


def remove_empty_playlists(t: dict, scope: list[str]) -> tuple[dict, dict]:
    playlists = t["Tag"].where(F.col("Type") == schema.PLAYLIST_TYPE)
    gone = materialize(unreferenced(playlists, scope, "TagId", (t["TagMap"], "TagId")).select(*scope, "TagId"), "gone-playlists")
    return {"Tag": t["Tag"].join(gone, [*scope, "TagId"], "left_anti")}, {"emptyPlaylists": gone}


def remove_unreferenced_locations(t: dict, scope: list[str]) -> tuple[dict, dict]:
    uses = location_references(t)
    gone = unreferenced(t["Location"], scope, "LocationId", *uses).select(*scope, "LocationId")
    return {"Location": referenced(t["Location"], scope, "LocationId", *uses)}, {"unreferencedLocations": gone}


_STEPS = {
    "emptyNotes": remove_empty_notes,
    "rangelessHighlights": remove_rangeless_marks,
    "duplicateHighlights": merge_duplicate_marks,
    "unusedMedia": remove_unused_media,
    "emptyPlaylists": remove_empty_playlists,
    "unreferencedLocations": remove_unreferenced_locations,
}


def apply_cleanups(tables: Mapping[str, DataFrame], scope: list[str], options: dict[str, bool] | None = None) -> Cleaned:
    """Run the enabled clean-ups in their fixed order; the input tables are left as they are."""
    chosen = {**DEFAULTS, **(options or {})}
    out = Cleaned(Changed(list(scope)), dict(tables) if isinstance(tables, dict) else tables, list(scope))
    for name, step in _STEPS.items():
        if chosen[name]:
            # Later steps and all readers go on from what this step left, not from its joins; only notes, whose texts no
            # step after the first reads, go from step to step unwritten.
            notes = {"Note": out.changed.slim("Note")} if "Note" in out.changed else {}
            changed, acted = step(ChainMap(notes, out.tables), out.scope)
            for table, df in changed.items():
                out.changed.put(table, df)
            out.acted.update(acted)
    return out
