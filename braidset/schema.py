"""Registries of the snapshot data model: columns, keys, references and row rules.

A snapshot set is a ``dict`` of table name -> DataFrame. Every DataFrame carries
the scope columns (owner of the data, possibly none), ``src`` (ordinal of the
source snapshot) and the registry columns of its table.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Tables parents-first, with their columns in storage order.
COLUMNS = {
    "Location": "LocationId bigint, BookNumber int, ChapterNumber int, DocumentId bigint, Track int, "
    "IssueTagNumber int, KeySymbol string, MepsLanguage int, Type int, Title string, "
    "Specialty string, Edition string",
    "UserMark": "UserMarkId bigint, ColorIndex int, LocationId bigint, StyleIndex int, "
    "UserMarkGuid string, Version int",
    "IndependentMedia": "IndependentMediaId bigint, OriginalFilename string, FilePath string, "
    "MimeType string, Hash string",
    "BlockRange": "BlockRangeId bigint, BlockType int, Identifier bigint, StartToken int, "
    "EndToken int, UserMarkId bigint",
    "Note": "NoteId bigint, Guid string, UserMarkId bigint, LocationId bigint, Title string, "
    "Content string, LastModified string, Created string, BlockType int, BlockIdentifier bigint",
    "Bookmark": "BookmarkId bigint, LocationId bigint, PublicationLocationId bigint, Slot int, "
    "Title string, Snippet string, BlockType int, BlockIdentifier bigint",
    "InputField": "LocationId bigint, TextTag string, Value string",
    "Tag": "TagId bigint, Type int, Name string",
    "PlaylistItemAccuracy": "PlaylistItemAccuracyId bigint, Description string",
    "PlaylistItem": "PlaylistItemId bigint, Label string, StartTrimOffsetTicks bigint, "
    "EndTrimOffsetTicks bigint, Accuracy bigint, EndAction int, ThumbnailFilePath string",
    "PlaylistItemLocationMap": "PlaylistItemId bigint, LocationId bigint, MajorMultimediaType int, "
    "BaseDurationTicks bigint",
    "PlaylistItemIndependentMediaMap": "PlaylistItemId bigint, IndependentMediaId bigint, DurationTicks bigint",
    "PlaylistItemMarker": "PlaylistItemMarkerId bigint, PlaylistItemId bigint, Label string, "
    "StartTimeTicks bigint, DurationTicks bigint, EndTransitionDurationTicks bigint",
    "PlaylistItemMarkerBibleVerseMap": "PlaylistItemMarkerId bigint, VerseId bigint",
    "PlaylistItemMarkerParagraphMap": "PlaylistItemMarkerId bigint, MepsDocumentId bigint, "
    "ParagraphIndex int, MarkerIndexWithinParagraph int",
    "TagMap": "TagMapId bigint, PlaylistItemId bigint, LocationId bigint, NoteId bigint, "
    "TagId bigint, Position bigint",
}

TABLES = tuple(COLUMNS)

# Bookkeeping tables every source database must also hold.
SYSTEM_TABLES = ("grdb_migrations", "LastModified")

# Tables whose key is more than their first column.
_COMPOSITE_KEYS = {
    "InputField": ["LocationId", "TextTag"],
    "PlaylistItemLocationMap": ["PlaylistItemId", "LocationId"],
    "PlaylistItemIndependentMediaMap": ["PlaylistItemId", "IndependentMediaId"],
    "PlaylistItemMarkerBibleVerseMap": ["PlaylistItemMarkerId", "VerseId"],
    "PlaylistItemMarkerParagraphMap": [
        "PlaylistItemMarkerId",
        "MepsDocumentId",
        "ParagraphIndex",
        "MarkerIndexWithinParagraph",
    ],
}

# Fixed values: (child table, column, parent table, parent column).
FOREIGN_KEYS = (
    ("UserMark", "LocationId", "Location", "LocationId"),
    ("BlockRange", "UserMarkId", "UserMark", "UserMarkId"),
    ("Note", "UserMarkId", "UserMark", "UserMarkId"),
    ("Note", "LocationId", "Location", "LocationId"),
    ("Bookmark", "LocationId", "Location", "LocationId"),
    ("Bookmark", "PublicationLocationId", "Location", "LocationId"),
    ("InputField", "LocationId", "Location", "LocationId"),
    ("PlaylistItem", "Accuracy", "PlaylistItemAccuracy", "PlaylistItemAccuracyId"),
    ("PlaylistItem", "ThumbnailFilePath", "IndependentMedia", "FilePath"),
    ("PlaylistItemLocationMap", "PlaylistItemId", "PlaylistItem", "PlaylistItemId"),
    ("PlaylistItemLocationMap", "LocationId", "Location", "LocationId"),
    ("PlaylistItemIndependentMediaMap", "PlaylistItemId", "PlaylistItem", "PlaylistItemId"),
    ("PlaylistItemIndependentMediaMap", "IndependentMediaId", "IndependentMedia", "IndependentMediaId"),
    ("PlaylistItemMarker", "PlaylistItemId", "PlaylistItem", "PlaylistItemId"),
    ("PlaylistItemMarkerBibleVerseMap", "PlaylistItemMarkerId", "PlaylistItemMarker", "PlaylistItemMarkerId"),
    ("PlaylistItemMarkerParagraphMap", "PlaylistItemMarkerId", "PlaylistItemMarker", "PlaylistItemMarkerId"),
    ("TagMap", "TagId", "Tag", "TagId"),
    ("TagMap", "PlaylistItemId", "PlaylistItem", "PlaylistItemId"),
    ("TagMap", "LocationId", "Location", "LocationId"),
    ("TagMap", "NoteId", "Note", "NoteId"),
)

# Unique constraints besides the primary key, as SQL expressions.
# A row takes part only when every expression is non-null.
UNIQUE_KEYS = (
    ("Location", "place", ["BookNumber", "ChapterNumber", "KeySymbol", "MepsLanguage", "Type"]),
    (
        "Location",
        "media",
        ["KeySymbol", "IssueTagNumber", "MepsLanguage", "DocumentId", "Track", "Type",
         "coalesce(Specialty, '')", "coalesce(Edition, '')"],
    ),
    ("UserMark", "guid", ["UserMarkGuid"]),
    ("Note", "guid", ["Guid"]),
    ("Bookmark", "slot", ["PublicationLocationId", "Slot"]),
    ("IndependentMedia", "path", ["FilePath"]),
    ("Tag", "name", ["Type", "Name"]),
    ("TagMap", "position", ["TagId", "Position"]),
    ("TagMap", "note", ["TagId", "NoteId"]),
    ("TagMap", "location", ["TagId", "LocationId"]),
    ("TagMap", "item", ["TagId", "PlaylistItemId"]),
    ("PlaylistItemAccuracy", "description", ["Description"]),
    ("PlaylistItemMarker", "start", ["PlaylistItemId", "StartTimeTicks"]),
)

_BLOCK_PAIR = (
    "(BlockType = 0 AND BlockIdentifier IS NULL) OR (BlockType IN (1, 2) AND BlockIdentifier IS NOT NULL)"
)
_HAS_SYMBOL = "coalesce(length(KeySymbol), 0) > 0"
_NO_PLACE = "coalesce(BookNumber, 0) = 0 AND coalesce(ChapterNumber, 0) = 0"

# Row rules as SQL; a rule that evaluates to NULL counts as met.
ROW_RULES = (
    (
        "Location",
        "document or named place",
        "Type <> 0 OR coalesce(DocumentId, 0) <> 0 OR "
        f"({_HAS_SYMBOL} AND (Track IS NOT NULL OR coalesce(BookNumber, 0) <> 0))",
    ),
    (
        "Location",
        "publication",
        f"Type <> 1 OR ({_NO_PLACE} AND coalesce(DocumentId, 0) = 0 AND {_HAS_SYMBOL} AND Track IS NULL)",
    ),
    ("Location", "recording", f"Type NOT IN (2, 3) OR ({_NO_PLACE})"),
    ("BlockRange", "block type", "BlockType BETWEEN 1 AND 2"),
    ("Note", "block pair", _BLOCK_PAIR),
    ("Bookmark", "block pair", _BLOCK_PAIR),
    ("IndependentMedia", "original name", "length(OriginalFilename) > 0"),
    ("IndependentMedia", "path", "length(FilePath) > 0"),
    ("IndependentMedia", "mime type", "length(MimeType) > 0"),
    ("IndependentMedia", "hash", "length(Hash) > 0"),
    ("PlaylistItem", "label", "length(Label) > 0"),
    ("PlaylistItem", "end action", "EndAction IN (0, 1, 2, 3)"),
    ("Tag", "name", "length(Name) > 0"),
    ("Tag", "type", "Type IN (0, 1, 2)"),
    (
        "TagMap",
        "one target",
        "CAST(NoteId IS NOT NULL AS INT) + CAST(LocationId IS NOT NULL AS INT) "
        "+ CAST(PlaylistItemId IS NOT NULL AS INT) = 1",
    ),
)

# Columns that may be null; every other column may not.
NULLABLE = {
    "Location": {"BookNumber", "ChapterNumber", "DocumentId", "Track", "KeySymbol", "MepsLanguage",
                 "Title", "Specialty", "Edition"},
    "BlockRange": {"StartToken", "EndToken"},
    "Note": {"UserMarkId", "LocationId", "Title", "Content", "BlockIdentifier"},
    "Bookmark": {"Snippet", "BlockIdentifier"},
    "TagMap": {"PlaylistItemId", "LocationId", "NoteId"},
    "PlaylistItem": {"StartTrimOffsetTicks", "EndTrimOffsetTicks", "ThumbnailFilePath"},
    "PlaylistItemLocationMap": {"BaseDurationTicks"},
}

PLAYLIST_TYPE = 2
BLANK_TITLE = " "
KEEP_BOTH = -1


def columns(table: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in COLUMNS[table].split(",")]


def primary_key(table: str) -> list[str]:
    return _COMPOSITE_KEYS.get(table, columns(table)[:1])


def struct_type(table: str) -> T.StructType:
    """Spark schema of a table without the scope and source columns."""
    kinds = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    pairs = [c.strip().split(" ") for c in COLUMNS[table].split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs])


def not_null_columns(table: str) -> list[str]:
    return [c for c in columns(table) if c not in NULLABLE.get(table, set())]
