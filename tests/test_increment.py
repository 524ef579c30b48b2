"""Late snapshots against a merged result: the same outcome as merging the whole again, rows that are not touched kept with their ids."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidset import schema
from braidset.plans import analyze, finalize as fin, validate
from braidset.plans.analyze import Analysis
from braidset.sources import publish
from braidset.streaming import increment
from braidset.streaming.increment import merge_increment, merge_late, touched_rows
from fleet import FLEET, natural
from rows import build, document, source

ABOUT = ["'Merged' AS DeviceName", "SchemaVersion", "MigrationId", "UserVersion", "'2025-12-30T00:00:00Z' AS LastModified"]


def playlists(number: int) -> dict:
    """Items with media, places and markers; the second device has one item more, the third changes a path and repeats names."""
    shift = 100 * number
    items = [1, 2] if number == 0 else [2, 3] if number == 1 else [1, 4]
    rows = {
        "Location": [document(shift + i, 500 + i) for i in items],
        "PlaylistItemAccuracy": [{"PlaylistItemAccuracyId": shift + 1, "Description": "exact"}],
        "IndependentMedia": [{"IndependentMediaId": shift + i, "FilePath": f"p{i if i < 4 else 1}.png", "Hash": f"hash{i}"} for i in items],
        "PlaylistItem": [{"PlaylistItemId": shift + i, "Label": f"item {i % 3}", "Accuracy": shift + 1, "EndTrimOffsetTicks": i,
                          "ThumbnailFilePath": f"p{i if i < 4 else 1}.png"} for i in items],
        "PlaylistItemLocationMap": [{"PlaylistItemId": shift + i, "LocationId": shift + i} for i in items],
        "PlaylistItemIndependentMediaMap": [{"PlaylistItemId": shift + i, "IndependentMediaId": shift + i} for i in items],
        "PlaylistItemMarker": [{"PlaylistItemMarkerId": shift + 10 * i + m, "PlaylistItemId": shift + i, "StartTimeTicks": 100 * m} for i in items for m in (1, 2)],
        "PlaylistItemMarkerBibleVerseMap": [{"PlaylistItemMarkerId": shift + 10 * i + 1, "VerseId": 7 * i} for i in items],
        "PlaylistItemMarkerParagraphMap": [{"PlaylistItemMarkerId": shift + 10 * i + 2, "MepsDocumentId": 3, "ParagraphIndex": i} for i in items],
        "Tag": [{"TagId": shift + 5, "Type": 2, "Name": "list"}],
        "TagMap": [{"TagMapId": shift + i, "TagId": shift + 5, "PlaylistItemId": shift + i, "Position": p} for p, i in enumerate(items)],
    }
    return source(f"Player{number}", rows, f"2026-0{number + 1}-01T00:00:00Z")


SETS = {o: FLEET[o] for o in ("owner3", "owner5", "owner6")} | {"player": [playlists(n) for n in range(3)]}
EARLY = {o: s[:-1] for o, s in SETS.items()}
LATE = {o: s[-1:] for o, s in SETS.items()}


def content(tables) -> dict[str, Counter]:
    """Rows of every owner told by what they say, not by their ids."""
    rows = {t: [r.asDict() for r in df.collect()] for t, df in tables.items()}
    at = lambda table, key, text: {(r["owner"], r[key]): text(r) for r in rows[table]}
    places, marks = at("Location", "LocationId", natural), at("UserMark", "UserMarkId", lambda r: r["UserMarkGuid"])
    notes, tags = at("Note", "NoteId", lambda r: r["Guid"]), at("Tag", "TagId", lambda r: r["Name"])
    items = at("PlaylistItem", "PlaylistItemId", lambda r: (r["Label"], r["EndTrimOffsetTicks"], r["ThumbnailFilePath"]))
    markers = at("PlaylistItemMarker", "PlaylistItemMarkerId", lambda r: (items[r["owner"], r["PlaylistItemId"]], r["StartTimeTicks"]))
    media = at("IndependentMedia", "IndependentMediaId", lambda r: r["Hash"])
    known = {"LocationId": places, "PublicationLocationId": places, "UserMarkId": marks, "NoteId": notes, "TagId": tags,
             "PlaylistItemId": items, "PlaylistItemMarkerId": markers, "IndependentMediaId": media}
    own = {"BlockRangeId", "BookmarkId", "TagMapId", "PlaylistItemAccuracyId", "Accuracy"}
    said = lambda r: tuple((c, known[c].get((r["owner"], v), v) if c in known and v is not None else v) for c, v in sorted(r.items()) if c not in own)
    return {t: Counter(map(said, rows[t])) for t in schema.TABLES}


@pytest.fixture(scope="module")
def world(spark):
    tables, sources, files = build(spark, EARLY)
    merged = fin.finalize(Analysis(tables, sources, ["owner"], files)).tables
    about = sources.where("src = 0").selectExpr("owner", "src", "FileName", *ABOUT)
    return merged, about, (tables, sources, files)


def test_late_snapshots_give_what_a_whole_merge_gives(spark, world):
    merged, about, _ = world
    late, sources, files = build(spark, LATE)
    whole = fin.finalize(merge_increment(merged, about, late, sources, ["owner"], files))
    increment = merge_late(merged, about, late, sources, ["owner"], files)
    done = increment.finalize()
    got, want = content(done.tables), content(whole.tables)
    assert {t: got[t] - want[t] for t in got if got[t] != want[t]} == {}
    assert Counter((r["owner"], r["kind"], r["winner_src"]) for r in done.decisions.collect()) == Counter((r["owner"], r["kind"], r["winner_src"]) for r in whole.decisions.collect())
    for check in (validate.fk_violations, validate.constraint_violations, validate.unique_violations):
        assert not [r for r in check(done.tables, ["owner"]).collect() if r["violations"]]
    # Rows that were not touched are what they were, and merged rows keep their ids.
    before = {t: Counter(map(repr, merged[t].collect())) for t in schema.TABLES}
    after = {t: Counter(map(repr, done.tables[t].select(merged[t].columns).collect())) for t in schema.TABLES}
    for t in schema.TABLES:
        kept = Counter(map(repr, increment.untouched[t].select(merged[t].columns).collect()))
        assert not kept - before[t] and not kept - after[t], t
    guids = {(r["owner"], r["Guid"]): r["NoteId"] for r in merged["Note"].collect()}
    assert all(guids.get((r["owner"], r["Guid"]), r["NoteId"]) == r["NoteId"] for r in done.tables["Note"].collect())


def test_keeping_every_version_takes_ids_above_all_rows(spark, world):
    merged, about, _ = world
    late, sources, files = build(spark, LATE)
    increment = merge_late(merged, about, late, sources, ["owner"], files)
    choices = increment.analysis.conflicts.selectExpr("owner", "conflict_id", "-1 AS choice")
    done = increment.finalize(choices)
    assert choices.count() and not [r for r in validate.unique_violations(done.tables, ["owner"]).collect() if r["violations"]]
    assert not [r for r in validate.fk_violations(done.tables, ["owner"]).collect() if r["violations"]]


def test_the_result_once_more_changes_nothing(spark, world):
    merged, about, (_, _, files) = world
    late = {t: df.withColumn("src", F.lit(0)) for t, df in merged.items()}
    done = merge_late(merged, about, late, about, ["owner"], files.limit(0)).finalize()
    for t in schema.TABLES:
        assert Counter(map(repr, done.tables[t].select(merged[t].columns).collect())) == Counter(map(repr, merged[t].collect())), t
    assert done.decisions.count() == 0


def test_a_small_late_snapshot_touches_little(spark, world):
    merged = world[0]
    one = {"owner5": [source("New", {"Location": [document(1, 1)], "Note": [{"NoteId": 9, "Guid": "brand new", "LocationId": 1, "Content": "x"}]})]}
    touched = {t: df.count() for t, df in touched_rows(merged, build(spark, one)[0], ["owner"]).items()}
    assert not any(touched.values())
    guid = merged["Note"].where("owner = 'owner5' AND LocationId IS NOT NULL").first()["Guid"]
    one["owner5"][0]["rows"]["Note"][0]["Guid"] = guid
    touched = {t: df.count() for t, df in touched_rows(merged, build(spark, one)[0], ["owner"]).items()}
    assert touched["Note"] == 1 and touched["Location"] >= 1 and not touched["Bookmark"] and not touched["TagMap"]


def test_places_with_one_key_do_not_meet_in_pairs(spark, monkeypatch):
    """Many merged and late locations with one full key: what is written stays in proportion to them."""
    def shelf(device: str, n: int, shift: int) -> dict:
        rows = {"Location": [document(shift + i, 7) for i in range(n)], "InputField": [{"LocationId": shift + i, "TextTag": "box", "Value": "x"} for i in range(n)],
                "Bookmark": [{"BookmarkId": i + 1, "LocationId": shift + i, "PublicationLocationId": shift, "Slot": i} for i in range(n)]}
        return source(device, rows)

    merged, written = {t: df.drop("src") for t, df in build(spark, {"o": [shelf("A", 300, 1)]})[0].items()}, []
    keep = increment.materialize
    monkeypatch.setattr(increment, "materialize", lambda df, name, **o: written.append((name, keep(df, name, **o))) or written[-1][1])
    part = touched_rows(merged, build(spark, {"o": [shelf("B", 200, 5000)]})[0], ["owner"])
    assert {t: part[t].count() for t in ("Location", "InputField", "Bookmark")} == {"Location": 300, "InputField": 300, "Bookmark": 300}
    assert not [(name, df.count()) for name, df in written if df.count() > 500]


def test_a_path_of_two_media_does_not_multiply_items(spark):
    """The thumbnail is the last medium with the path; the item stays one row."""
    tables, sources, files = build(spark, {"player": [playlists(2)]})
    analysis = Analysis(tables, sources, ["owner"], files)
    assert sorted(r["Label"] for r in analysis.merged("PlaylistItem").collect()) == ["item 1", "item 1"]
    assert analysis.playlist_item.ids.count() == 2
    last = analysis.media.extra["paths"].where("FilePath = 'p1.png'").orderBy(F.desc("pk")).first()["new_path"]
    assert {r["ThumbnailFilePath"] for r in analysis.merged("PlaylistItem").collect()} == {last}


def test_one_table_of_a_late_merge_makes_only_what_it_needs(spark, world, monkeypatch):
    """Late notes need no ranges, no decisions on highlights and none of the tables that hang on those."""
    about = world[1]
    merged = {t: fin.materialize(df, f"early-{t}") for t, df in world[0].items()}
    late, sources, files = build(spark, LATE)
    made = []
    for module in (increment, analyze, fin, publish):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, real=real, **options: made.append(name) or real(df, name, **options))
    done = merge_late(publish.accepted_rows(merged, ["owner"]), about, late, sources, ["owner"], files).finalize()
    assert done.tables["Note"].count() and "rejected-Note" in made and "touched-Note" in made and "decisions-note" in made
    assert not {"mark-ranges", "conflicts-userMark", "decisions", "range-kept", "bookmark-copies", "items"} & set(made)
    assert not [n for n in made if n.endswith("-BlockRange")]
    assert done.decisions.count() >= 0 and "decisions-userMark" in made


def test_written_tables_are_checked_without_a_copy(spark, monkeypatch):
    """Rows of a written table are told apart where they lie, also equal ones; results are those of any other table."""
    place = [document(1, 1), document(1, 1), document(2, 2)]
    tables = {t: df.drop("src") for t, df in build(spark, {"o": [source("A", {"Location": place, "Note": [{"NoteId": 1, "Guid": "n", "LocationId": 9, "Content": "x"}]})]})[0].items()}
    made, real = [], publish.materialize
    written = {t: real(df, f"given-{t}") for t, df in tables.items()}
    monkeypatch.setattr(publish, "materialize", lambda df, name, **options: made.append(name) or real(df, name, **options))
    rejects, accepted = publish.find_rejects(written, ["owner"])
    assert not [n for n in made if n.startswith("checked-")]
    assert sorted((r["table"], r["rule"], r["row_key"]) for r in rejects.collect()) == [
        ("Location", "unique primary key", "1"), ("Note", "LocationId refers to Location", "1")]
    others = publish.find_rejects(tables, ["owner"])
    assert sorted(map(repr, others[0].collect())) == sorted(map(repr, rejects.collect()))
    assert {t: Counter(map(repr, df.collect())) for t, df in accepted.items()} == {t: Counter(map(repr, df.collect())) for t, df in others[1].items()}
