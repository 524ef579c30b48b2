"""Small builders for snapshot rows; defaults meet every row rule. All content is invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidset import schema

DEFAULTS = {
    "Location": {"IssueTagNumber": 0, "MepsLanguage": 0, "Type": 0, "Title": " "},
    "UserMark": {"ColorIndex": 1, "StyleIndex": 0, "Version": 1},
    "BlockRange": {"BlockType": 1, "StartToken": 0, "EndToken": 5},
    "Note": {"LastModified": "2024-01-01T00:00:00Z", "Created": "2024-01-01T00:00:00Z", "BlockType": 0},
    "Bookmark": {"Title": "mark", "BlockType": 0},
    "IndependentMedia": {"OriginalFilename": "image.png", "MimeType": "image/png"},
    "PlaylistItem": {"EndAction": 0},
    "PlaylistItemLocationMap": {"MajorMultimediaType": 2},
    "PlaylistItemIndependentMediaMap": {"DurationTicks": 50},
    "PlaylistItemMarker": {"Label": "m", "DurationTicks": 10, "EndTransitionDurationTicks": 0},
    "PlaylistItemMarkerParagraphMap": {"MarkerIndexWithinParagraph": 0},
}


def place(key: int, book: int, chapter: int, **more) -> dict:
    return {"LocationId": key, "BookNumber": book, "ChapterNumber": chapter, "KeySymbol": "bk", **more}


def document(key: int, number: int, symbol: str = "w", **more) -> dict:
    return {"LocationId": key, "DocumentId": number, "KeySymbol": symbol, **more}


def publication(key: int, symbol: str, **more) -> dict:
    return {"LocationId": key, "KeySymbol": symbol, "Type": 1, **more}


def recording(key: int, symbol: str, track: int, **more) -> dict:
    return {"LocationId": key, "KeySymbol": symbol, "Track": track, "Type": 2, **more}


def source(device: str, rows: dict | None = None, stamp: str = "2026-01-01T00:00:00Z", files: dict | None = None,
           migration: str = "v16", version: int = 16) -> dict:
    return {"device": device, "rows": rows or {}, "stamp": stamp, "files": files or {}, "migration": migration, "version": version}


def build(spark: SparkSession, sets: dict[str, list[dict]]) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Tables, registry and files of many owners' snapshots, scoped by ``owner``."""
    head = "owner string, src int, "
    flat: dict[str, list] = {t: [] for t in schema.TABLES}
    registry, files = [], []
    for owner, sources in sets.items():
        for src, s in enumerate(sources):
            registry.append((owner, src, s["device"].lower() + ".zip", s["device"], s["version"], s["migration"], 16, s["stamp"]))
            files += [(owner, src, path, content) for path, content in s["files"].items()]
            for table, rows in s["rows"].items():
                for row in rows:
                    full = {**DEFAULTS.get(table, {}), **row}
                    flat[table].append((owner, src, *[full.get(c) for c in schema.columns(table)]))
    tables = {t: spark.createDataFrame(rows, head + schema.COLUMNS[t]) for t, rows in flat.items()}
    about = "FileName string, DeviceName string, SchemaVersion int, MigrationId string, UserVersion int, LastModified string"
    return (
        tables,
        spark.createDataFrame(registry, head + about),
        spark.createDataFrame(files, head + "path string, content binary"),
    )
