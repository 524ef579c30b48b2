"""Consistency checks over one set of tables (a source or a merged result).

A check yields hits ``[*keys, code, n, o1, o2, o3, before, place_a, between, place_b, after,
group]``: ``n`` is the number of findings the row stands for, ``o*`` the row order, the rest
the parts of its sample text. Location descriptions are looked up for the few sampled hits
only. Dangling references to the same parent share one anti join.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from braidset import schema
from braidset.functions import keys as K
from braidset.functions.text import describe_location, is_empty_note, target_count
from braidset.operators.ordinals import ordinal_within, top_rows
from braidset.operators.remap import unreferenced
from braidset.plans.cleanup import duplicate_groups, location_references
from braidset.session import materialize

SAMPLES = 8
#: Highlights of a group that its sample text names.
LISTED = 16

# Code, category, clean-up that removes the rows, informational only.
CHECKS = (
    ("A1", "dangling", None, False, "notes whose location is missing"),
    ("A2", "dangling", None, False, "notes whose highlight is missing"),
    ("A3", "dangling", None, False, "highlights whose location is missing"),
    ("A4", "dangling", None, False, "ranges whose highlight is missing"),
    ("A5", "dangling", None, False, "bookmarks whose location is missing"),
    ("A6", "dangling", None, False, "bookmarks whose publication is missing"),
    ("A7", "dangling", None, False, "input fields whose location is missing"),
    ("A8", "dangling", None, False, "tag assignments whose note is missing"),
    ("A9", "dangling", None, False, "tag assignments whose location is missing"),
    ("A10", "dangling", None, False, "tag assignments whose playlist item is missing"),
    ("A11", "dangling", None, False, "tag assignments whose tag is missing"),
    ("A12", "dangling", None, False, "playlist items with an unknown accuracy"),
    ("A13", "dangling", None, False, "playlist items whose thumbnail has no media row"),
    ("A14", "dangling", None, False, "playlist links whose item is missing"),
    ("A15", "dangling", None, False, "playlist links whose location is missing"),
    ("A16", "dangling", None, False, "playlist links whose media row is missing"),
    ("A17", "dangling", None, False, "marker details whose marker is missing"),
    ("B1", "unreferenced", "unreferencedLocations", False, "locations nothing refers to"),
    ("B2", "unreferenced", "rangelessHighlights", False, "highlights without ranges"),
    ("B3", "unreferenced", None, True, "tags without assignments"),
    ("B4", "unreferenced", "unusedMedia", False, "media no playlist item uses"),
    ("B5", "unreferenced", None, True, "playlist items outside every playlist"),
    ("B6", "unreferenced", None, True, "playlist items without content"),
    ("B7", "unreferenced", None, True, "notes without location and highlight"),
    ("B8", "unreferenced", "emptyNotes", False, "empty notes without a tag"),
    ("B9", "unreferenced", "emptyPlaylists", True, "playlists without items"),
    ("C1", "inconsistent", None, True, "notes placed elsewhere than their highlight"),
    ("C2", "inconsistent", None, True, "bookmarks into another publication or language"),
    ("C3", "inconsistent", None, False, "repeated ranges inside a highlight"),
    ("C4", "inconsistent", "duplicateHighlights", False, "highlights equal in place, ranges and look"),
    ("C5", "inconsistent", None, True, "highlights equal in place and ranges, unlike in look"),
    ("C6", "inconsistent", None, False, "tag assignments without exactly one target"),
    ("D1", "archive", None, False, "media rows without a file"),
    ("D2", "archive", None, False, "files without a media row"),
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(CHECKS)], "seq int, code string, category string, cleanup string, info boolean, label string"
    )


def _say(template: str) -> Column:
    """Text with ``{Column}`` placeholders; a null column reads 'null'."""
    pieces = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        if part:
            pieces.append(F.lit(part) if i % 2 == 0 else F.coalesce(F.col(part).cast("string"), F.lit("null")))
    return F.concat(*pieces)


class Health:
    """Checks over tables with the key columns ``keys`` (scope, or scope and source)."""

    def __init__(self, tables: dict[str, DataFrame], keys: list[str], files: DataFrame | None = None) -> None:
        self.t, self.keys, self.files = tables, list(keys), files
        self.spark = tables["Location"].sparkSession

    def _hit(self, df: DataFrame, code: str, order: list, sample: Column | None = None, n: Column | None = None,
             place_a: Column | None = None, place_b: Column | None = None, between: Column | None = None,
             after: Column | None = None, group: Column | None = None, also: list[str] = ()) -> DataFrame:
        none, text = F.lit(None), F.lit("")
        order = [*order, *[F.lit(0)] * (2 - len(order))]
        return df.select(
            *self.keys, *also, F.lit(code).alias("code"), (F.lit(1) if n is None else n).cast("bigint").alias("n"),
            order[0].cast("bigint").alias("o1"), order[1].cast("bigint").alias("o2"),
            (text if len(order) < 3 else order[2]).cast("string").alias("o3"),
            (text if sample is None else sample).alias("before"),
            # A place is an array of at most one id: null = none shown, [] = "no location".
            (none if place_a is None else F.when(place_a.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(place_a))).cast("array<bigint>").alias("place_a"),
            (text if between is None else between).alias("between"),
            (none if place_b is None else F.when(place_b.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(place_b))).cast("array<bigint>").alias("place_b"),
            (text if after is None else after).alias("after"),
            (none.cast("string") if group is None else group).alias("group"),
        )

    # -------------------------------------------------------------- dangling references
    # Code, child table, column, order columns, sample format.
    _DANGLING = {
        ("Location", "LocationId"): (
            ("A1", "Note", "LocationId", ("NoteId",), "note #{NoteId} → location #{_ref}"),
            ("A3", "UserMark", "LocationId", ("UserMarkId",), "highlight #{UserMarkId} → location #{_ref}"),
            ("A5", "Bookmark", "LocationId", ("BookmarkId",), "bookmark #{BookmarkId} → location #{_ref}"),
            ("A6", "Bookmark", "PublicationLocationId", ("BookmarkId",), "bookmark #{BookmarkId} → publication location #{_ref}"),
            ("A7", "InputField", "LocationId", ("LocationId", None, "TextTag"), 'field "{TextTag}" → location #{_ref}'),
            ("A9", "TagMap", "LocationId", ("TagMapId",), "tag assignment #{TagMapId} → location #{_ref}"),
            ("A15", "PlaylistItemLocationMap", "LocationId", ("PlaylistItemId", "LocationId"), "playlist item #{PlaylistItemId} → location #{_ref}"),
        ),
        ("UserMark", "UserMarkId"): (
            ("A2", "Note", "UserMarkId", ("NoteId",), "note #{NoteId} → highlight #{_ref}"),
            ("A4", "BlockRange", "UserMarkId", ("BlockRangeId",), "range #{BlockRangeId} → highlight #{_ref}"),
        ),
        ("Note", "NoteId"): (("A8", "TagMap", "NoteId", ("TagMapId",), "tag assignment #{TagMapId} → note #{_ref}"),),
        ("PlaylistItem", "PlaylistItemId"): (
            ("A10", "TagMap", "PlaylistItemId", ("TagMapId",), "tag assignment #{TagMapId} → playlist item #{_ref}"),
            ("A14", "PlaylistItemLocationMap", "PlaylistItemId", (0, "PlaylistItemId", "LocationId"), "location link → playlist item #{_ref}"),
            ("A14", "PlaylistItemIndependentMediaMap", "PlaylistItemId", (1, "PlaylistItemId", "IndependentMediaId"), "media link → playlist item #{_ref}"),
            ("A14", "PlaylistItemMarker", "PlaylistItemId", (2, "PlaylistItemMarkerId"), "marker #{PlaylistItemMarkerId} → playlist item #{_ref}"),
        ),
        ("Tag", "TagId"): (("A11", "TagMap", "TagId", ("TagMapId",), "tag assignment #{TagMapId} → tag #{_ref}"),),
        ("PlaylistItemAccuracy", "PlaylistItemAccuracyId"): (
            ("A12", "PlaylistItem", "Accuracy", ("PlaylistItemId",), "playlist item #{PlaylistItemId} → accuracy #{_ref}"),
        ),
        ("IndependentMedia", "FilePath"): (
            ("A13", "PlaylistItem", "ThumbnailFilePath", ("PlaylistItemId",), "playlist item #{PlaylistItemId} → {_ref}"),
        ),
        ("IndependentMedia", "IndependentMediaId"): (
            ("A16", "PlaylistItemIndependentMediaMap", "IndependentMediaId", ("PlaylistItemId", "IndependentMediaId"), "playlist item #{PlaylistItemId} → media #{_ref}"),
        ),
        ("PlaylistItemMarker", "PlaylistItemMarkerId"): (
            ("A17", "PlaylistItemMarkerBibleVerseMap", "PlaylistItemMarkerId", (0, "PlaylistItemMarkerId", "VerseId"), "verse link → marker #{_ref}"),
            ("A17", "PlaylistItemMarkerParagraphMap", "PlaylistItemMarkerId", (1, "PlaylistItemMarkerId", "ParagraphIndex"), "paragraph link → marker #{_ref}"),
        ),
    }

    def dangling(self, codes: set[str]) -> list[DataFrame]:
        parts = []
        for (parent, column), checks in self._DANGLING.items():
            refs = []
            for code, child, ref, order, sample in checks:
                if code in codes:
                    rows = self.t[child].where(F.col(ref).isNotNull()).withColumn("_ref", F.col(ref))
                    cols = [F.lit(o) if isinstance(o, int) else F.lit(0) if o is None else F.col(o) for o in order]
                    refs.append(self._hit(rows, code, cols, _say(sample), also=["_ref"]))
            if refs:
                known = self.t[parent].select(*self.keys, F.col(column).alias("_ref"))
                parts.append(reduce(DataFrame.unionByName, refs).join(known, [*self.keys, "_ref"], "left_anti").drop("_ref"))
        return parts

    # ---------------------------------------------------------------- other checks
    def b1(self) -> DataFrame:
        rows = unreferenced(self.t["Location"], self.keys, "LocationId", *location_references(self.t))
        return self._hit(rows, "B1", [F.col("LocationId")], _say("#{LocationId} "), place_a=F.col("LocationId"))

    def b2(self) -> DataFrame:
        rows = unreferenced(self.t["UserMark"], self.keys, "UserMarkId", (self.t["BlockRange"], "UserMarkId"))
        return self._hit(rows, "B2", [F.col("UserMarkId")], _say("highlight #{UserMarkId} at "), place_a=F.col("LocationId"))

    def _unused_tags(self, code: str, playlists: bool, word: str) -> DataFrame:
        kind = F.col("Type") == schema.PLAYLIST_TYPE
        rows = unreferenced(self.t["Tag"].where(kind if playlists else ~kind), self.keys, "TagId", (self.t["TagMap"], "TagId"))
        return self._hit(rows, code, [F.col("TagId")], _say(word + ' "{Name}"'))

    def b3(self) -> DataFrame:
        return self._unused_tags("B3", False, "tag")

    def b9(self) -> DataFrame:
        return self._unused_tags("B9", True, "playlist")

    def b4(self) -> DataFrame:
        media = unreferenced(self.t["IndependentMedia"], self.keys, "IndependentMediaId", (self.t["PlaylistItemIndependentMediaMap"], "IndependentMediaId"))
        rows = unreferenced(media, self.keys, "FilePath", (self.t["PlaylistItem"], "ThumbnailFilePath"))
        return self._hit(rows, "B4", [F.col("IndependentMediaId")], _say("{OriginalFilename} ({FilePath})"))

    def _items(self, code: str, *used: tuple[str, str]) -> DataFrame:
        uses = [(self.t[table], column) for table, column in used]
        rows = unreferenced(self.t["PlaylistItem"], self.keys, "PlaylistItemId", *uses)
        return self._hit(rows, code, [F.col("PlaylistItemId")], _say('playlist item #{PlaylistItemId} "{Label}"'))

    def b5(self) -> DataFrame:
        return self._items("B5", ("TagMap", "PlaylistItemId"))

    def b6(self) -> DataFrame:
        return self._items("B6", ("PlaylistItemLocationMap", "PlaylistItemId"), ("PlaylistItemIndependentMediaMap", "PlaylistItemId"))

    def b7(self) -> DataFrame:
        rows = self.t["Note"].where("LocationId IS NULL AND UserMarkId IS NULL")
        return self._hit(rows, "B7", [F.col("NoteId")], _say("note #{NoteId}"))

    def b8(self) -> DataFrame:
        rows = unreferenced(self.t["Note"].where(is_empty_note()), self.keys, "NoteId", (self.t["TagMap"], "NoteId"))
        return self._hit(rows, "B8", [F.col("NoteId")], _say("note #{NoteId} at "), place_a=F.col("LocationId"))

    def c1(self) -> DataFrame:
        marks = self.t["UserMark"].select(*self.keys, "UserMarkId", F.col("LocationId").alias("_mark_place"))
        rows = self.t["Note"].where("LocationId IS NOT NULL").join(marks, [*self.keys, "UserMarkId"]).where("LocationId <> _mark_place")
        return self._hit(rows, "C1", [F.col("NoteId")], _say("note #{NoteId}: "), place_a=F.col("LocationId"),
                         between=F.lit(" vs highlight at "), place_b=F.col("_mark_place"))

    def c2(self) -> DataFrame:
        def side(column: str, prefix: str) -> DataFrame:
            return self.t["Location"].select(
                *self.keys, F.col("LocationId").alias(column), F.coalesce("KeySymbol", F.lit("")).alias(prefix + "sym"),
                F.coalesce("MepsLanguage", F.lit(-1)).alias(prefix + "lang"),
            )

        marks = self.t["Bookmark"].join(side("LocationId", "a_"), [*self.keys, "LocationId"])
        marks = marks.join(side("PublicationLocationId", "b_"), [*self.keys, "PublicationLocationId"])
        rows = marks.where("a_sym <> b_sym OR a_lang <> b_lang")
        return self._hit(rows, "C2", [F.col("BookmarkId")], _say("bookmark #{BookmarkId}: "), place_a=F.col("LocationId"),
                         between=F.lit(" recorded under "), place_b=F.col("PublicationLocationId"))

    def c3(self) -> DataFrame:
        ranges = self.t["BlockRange"].withColumn("_sig", K.range_key())
        per_sig = ranges.groupBy(*self.keys, "UserMarkId", "_sig").agg(F.count("*").alias("_c"), F.min("BlockRangeId").alias("_o"))
        rows = per_sig.groupBy(*self.keys, "UserMarkId").agg(F.sum(F.col("_c") - 1).alias("_extra"), F.min("_o").alias("_o")).where("_extra > 0")
        return self._hit(rows, "C3", [F.col("_o")], _say("highlight #{UserMarkId}"), F.col("_extra"))

    @cached_property
    def _styled(self) -> DataFrame:
        """Highlights that have ranges by place and ranges (``_pair``) and look; several checks and their samples read this one table."""
        marks = duplicate_groups(self.t, self.keys)
        styled = marks.withColumn("_style", F.concat_ws("/", "ColorIndex", "StyleIndex")).withColumn(
            "_pair", K.key_of("LocationId", "ranges")
        )
        return materialize(styled.select(*self.keys, "UserMarkId", "LocationId", "_pair", "_style"), "styled-marks", compression="zstd")

    def c4(self) -> DataFrame:
        marks = self._styled
        per_style = marks.groupBy(*self.keys, "_pair", "LocationId", "_style").agg(
            F.count("*").alias("_c"), F.min("UserMarkId").alias("_o")
        ).where("_c > 1")
        lead = marks.groupBy(*self.keys, "_pair").agg(F.min("UserMarkId").alias("_lead"))
        rows = per_style.join(lead, [*self.keys, "_pair"])
        return self._hit(rows, "C4", [F.col("_lead"), F.col("_o")], n=F.col("_c") - 1, place_a=F.col("LocationId"),
                         group=K.key_of("_pair", "_style"))

    def c5(self) -> DataFrame:
        rows = self._styled.groupBy(*self.keys, "_pair", "LocationId").agg(
            F.count("*").alias("_c"), F.min("UserMarkId").alias("_o"), F.min("_style").alias("_s1"), F.max("_style").alias("_s2")
        ).where("_s1 <> _s2")
        return self._hit(rows, "C5", [F.col("_o")], n=F.col("_c") - 1, place_a=F.col("LocationId"), group=F.col("_pair"))

    def c6(self) -> DataFrame:
        return self._hit(self.t["TagMap"].where(target_count() != 1), "C6", [F.col("TagMapId")], _say("tag assignment #{TagMapId}"))

    def d1(self) -> DataFrame:
        files = self.files.select(*self.keys, F.col("path").alias("FilePath"))
        rows = self.t["IndependentMedia"].join(files, [*self.keys, "FilePath"], "left_anti")
        return self._hit(rows, "D1", [F.col("IndependentMediaId")], _say("{OriginalFilename} ({FilePath})"))

    def d2(self) -> DataFrame:
        known = self.t["IndependentMedia"].select(*self.keys, F.col("FilePath").alias("path"))
        rows = self.files.select(*self.keys, "path").distinct().join(known, [*self.keys, "path"], "left_anti")
        return self._hit(rows, "D2", [F.lit(0), F.lit(0), F.col("path")], _say("{path}"))

    # -------------------------------------------------------------------- reports
    def codes(self) -> list[str]:
        return [c[0] for c in CHECKS if self.files is not None or c[1] != "archive"]

    def hits(self, codes: list[str] | None = None) -> DataFrame:
        """Hits of the given checks (all that apply by default)."""
        wanted = [c for c in self.codes() if codes is None or c in codes]
        parts = self.dangling(set(wanted)) + [getattr(self, c.lower())() for c in wanted if c[0] != "A"]
        return reduce(DataFrame.unionByName, parts)

    def counts(self, codes: list[str] | None = None) -> DataFrame:
        """``[*keys, code, count]`` for checks with findings."""
        return self.hits(codes).groupBy(*self.keys, "code").agg(F.sum("n").alias("count"))

    def samples(self, hits: DataFrame, limit: int = SAMPLES) -> DataFrame:
        """Up to ``limit`` sample texts per check in row order; a hit of weight n counts n times."""
        top = top_rows(hits, [*self.keys, "code"], ["o1", "o2", "o3"], limit).drop("_rank")
        repeated = top.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(limit)).cast("int"))))
        few = materialize(top_rows(repeated, [*self.keys, "code"], ["o1", "o2", "o3", "_i"], limit), "samples")
        places = self.t["Location"].select(*self.keys, F.col("LocationId").alias("_id"), describe_location().alias("_text"))
        for side in ("place_a", "place_b"):
            ids = F.try_element_at(F.col(side), F.lit(1))
            few = few.withColumn("_id", ids).join(places, [*self.keys, "_id"], "left").withColumn(
                side + "_text",
                F.when(F.col(side).isNull(), "").when(F.size(side) == 0, "no location")
                .otherwise(F.coalesce("_text", F.lit("unknown location"))),
            ).drop("_id", "_text")
        few = self._list_marks(few)
        text = F.concat("before", "place_a_text", "between", "place_b_text", "after", "_marks")
        listed = few.groupBy(*self.keys, "code").agg(F.array_sort(F.collect_list(F.struct("_rank", text.alias("t")))).alias("_l"))
        return listed.select(*self.keys, "code", F.transform("_l", lambda x: x["t"]).alias("samples"))

    def members(self, groups: DataFrame | None = None) -> DataFrame:
        """Highlights of every group that C4 or C5 found: ``[*keys, code, group, nth, UserMarkId]``, numbered from 1 by id in a group.

        ``groups`` (``[*keys, code, group]``) are found ones if only their highlights are wanted.
        """
        parts = []
        for code, check, group in (("C4", self.c4, K.key_of("_pair", "_style")), ("C5", self.c5, F.col("_pair"))):
            found = check() if groups is None else groups.where(F.col("code") == code)
            listed = self._styled.select(*self.keys, F.lit(code).alias("code"), group.alias("group"), "UserMarkId")
            parts.append(listed.join(found.select(*self.keys, "group"), [*self.keys, "group"], "left_semi"))
        return ordinal_within(parts[0].unionByName(parts[1]), [*self.keys, "code", "group"], ["UserMarkId"], "nth")

    def _list_marks(self, few: DataFrame) -> DataFrame:
        """Ids of the first highlights of the sampled groups, and how many more there are (all of them are in ``members``)."""
        groups = materialize(few.where("group IS NOT NULL").select(*self.keys, "code", "group").distinct(), "sampled-groups")
        members = self.members(groups)
        first = F.when(F.col("nth") <= LISTED, F.struct("nth", "UserMarkId"))
        listed = members.groupBy(*self.keys, "code", "group").agg(F.array_sort(F.collect_list(first)).alias("_ids"), F.count("*").alias("_n"))
        names = F.transform("_ids", lambda i: F.concat(F.lit("#"), i["UserMarkId"].cast("string")))
        more = F.when(F.col("_n") > LISTED, F.concat(F.lit(" and "), (F.col("_n") - LISTED).cast("string"), F.lit(" more"))).otherwise("")
        listed = listed.withColumn("_marks", F.concat(F.lit(" (highlights "), F.array_join(names, ", "), more, F.lit(")"))).drop("_ids", "_n")
        return few.join(listed, [*self.keys, "code", "group"], "left").withColumn("_marks", F.coalesce("_marks", F.lit("")))

    def report(self, keys_df: DataFrame | None = None, with_samples: bool = True) -> DataFrame:
        """One row per check, also those without findings.

        ``keys_df`` lists the key combinations to report on; needed only when there are keys.
        """
        hits = self.hits()
        if with_samples:
            hits = materialize(hits, "hits")
        counted = hits.groupBy(*self.keys, "code").agg(F.sum("n").alias("count"))
        base = registry(self.spark).where(F.col("code").isin(self.codes()))
        if self.keys:
            every = F.array(*[F.lit(c) for c in self.codes()])
            combos = (keys_df if keys_df is not None else hits.select(*self.keys).distinct()).select(*self.keys)
            base = combos.withColumn("code", F.explode(every)).join(F.broadcast(base), "code")
        out = base.join(counted, [*self.keys, "code"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
        if with_samples:
            out = out.join(self.samples(hits), [*self.keys, "code"], "left").withColumn(
                "samples", F.coalesce("samples", F.array().cast("array<string>"))
            )
        return out


def problems(report: DataFrame) -> DataFrame:
    """Findings that are more than informational."""
    return report.where("count > 0 AND NOT info")


def informational(report: DataFrame) -> DataFrame:
    return report.where("count > 0 AND info")


def finding_for(report: DataFrame, cleanup: str) -> DataFrame:
    return report.where(F.col("cleanup") == cleanup)


def health_summary(report: DataFrame, keys: list[str]) -> DataFrame:
    """Checks run, checks with findings, problems."""
    return report.groupBy(*keys).agg(
        F.count("*").alias("checks"), F.count(F.when(F.col("count") > 0, 1)).alias("findings"),
        F.count(F.when((F.col("count") > 0) & ~F.col("info"), 1)).alias("problems"),
    )
