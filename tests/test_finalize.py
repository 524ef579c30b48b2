"""Final tables are made when they are asked for, with the stages they need and no others."""

from __future__ import annotations

from braidset import schema
from braidset.plans import analyze, cleanup, finalize as fin, health
from rows import build, document, source


def test_tables_are_made_on_first_use(spark, monkeypatch):
    def device(color):
        return source("Device", {
            "Location": [document(1, 5)],
            "UserMark": [{"UserMarkId": 1, "LocationId": 1, "UserMarkGuid": "g", "ColorIndex": color}],
            "BlockRange": [{"BlockRangeId": 7, "UserMarkId": 1, "Identifier": color}],
            "Note": [{"NoteId": 1, "Guid": "n", "LocationId": 1, "UserMarkId": 1, "Content": str(color)}],
        })

    tables, sources, files = build(spark, {"o": [device(1), device(2)]})
    made = []
    real = fin.materialize
    for module in (analyze, fin):
        monkeypatch.setattr(module, "materialize", lambda df, name, **options: made.append(name) or real(df, name, **options))
    analysis = analyze.Analysis(tables, sources, ["owner"], files)
    keep_all = analysis.conflicts.selectExpr("owner", "conflict_id", "-1 AS choice")
    result = fin.finalize(analysis, keep_all)
    assert {r["kind"]: r["kept_both"] for r in result.decisions.collect()} == {"userMark": True, "note": True}
    assert not [n for n in made if n.startswith("final-") or n in ("range-kept", "bookmark-copies", "items")]
    assert result.tables["UserMark"].count() == 2 and result.tables["UserMark"] is result.tables["UserMark"]
    assert [n for n in made if n.startswith("final-")] == ["final-UserMark"] and "range-kept" not in made
    assert list(result.tables) == list(schema.TABLES) and "Nothing" not in result.tables
    assert {t: df.count() for t, df in result.tables.items() if df.count()} == {"Location": 1, "UserMark": 2, "BlockRange": 2, "Note": 2}
    ranges = {(r["UserMarkId"], r["Identifier"]) for r in result.tables["BlockRange"].collect()}
    colors = {(r["UserMarkId"], r["ColorIndex"]) for r in result.tables["UserMark"].collect()}
    assert ranges == colors and made.count("kept-marks") == 1


def test_clean_ups_make_only_the_tables_they_read(spark, monkeypatch):
    """Media are cleaned without notes, highlights, ranges or decisions; notes without ranges' ids; what is left unmade is made later."""
    def device(color):
        return source("Device", {
            "Location": [document(1, 5)],
            "UserMark": [{"UserMarkId": 1, "LocationId": 1, "UserMarkGuid": "g", "ColorIndex": color}],
            "BlockRange": [{"BlockRangeId": 7, "UserMarkId": 1, "Identifier": color}],
            "Note": [{"NoteId": 1, "Guid": "n", "LocationId": 1, "UserMarkId": 1, "Content": str(color)}, {"NoteId": 2, "Guid": "blank"}],
            "IndependentMedia": [{"IndependentMediaId": 1, "FilePath": "a.jpg", "Hash": "h"}],
        })

    tables, sources, files = build(spark, {"o": [device(1), device(2)]})
    made = []
    real = fin.materialize
    for module in (analyze, fin, cleanup):
        monkeypatch.setattr(module, "materialize", lambda df, name, **options: made.append(name) or real(df, name, **options))
    result = fin.finalize(analyze.Analysis(tables, sources, ["owner"], files))
    chosen = lambda *names: {n: n in names for n in cleanup.DEFAULTS}
    media = cleanup.apply_cleanups(result.tables, ["owner"], chosen("unusedMedia"))
    assert media.tables["IndependentMedia"].count() == 0 and [(r["table"], r["removed"]) for r in media.removed().collect()] == [("IndependentMedia", 1)]
    assert not [n for n in made if n in ("decisions", "conflicts", "mark-ranges", "note-tagged") or n.startswith("final-")]
    notes = cleanup.apply_cleanups(result.tables, ["owner"], chosen("emptyNotes"))
    assert [r["Guid"] for r in notes.tables["Note"].collect()] == ["n"] and [(r["action"], r["n"]) for r in notes.summary().collect()] == [("emptyNotes", 1)]
    assert made.count("decisions") == 1 and [n for n in made if n.startswith("final-")] == ["final-Note"] and "range-kept" not in made
    assert {t: df.count() for t, df in notes.tables.items() if df.count()} == {"Location": 1, "UserMark": 1, "BlockRange": 1, "Note": 1, "IndependentMedia": 1}
    assert [r["kind"] for r in result.decisions.orderBy("kind").collect()] == ["note", "userMark"] and made.count("decisions") == 1
    nothing = cleanup.apply_cleanups(result.tables, ["owner"], chosen())
    assert nothing.summary().count() == 0 and nothing.removed().count() == 0


def test_conflicts_of_notes_need_no_ranges(spark, monkeypatch):
    """Notes, their candidates and their conflicts are made without ranges of highlights; links to highlights are those of the whole analysis."""
    def device(color):
        return source("Device", {
            "Location": [document(1, 5)],
            "UserMark": [{"UserMarkId": 1, "LocationId": 1, "UserMarkGuid": "g", "ColorIndex": color}, {"UserMarkId": 2, "LocationId": 9, "UserMarkGuid": "lost"}],
            "BlockRange": [{"BlockRangeId": 7, "UserMarkId": 1, "Identifier": color}],
            "Note": [{"NoteId": n, "Guid": f"n{n}", "LocationId": 1, "UserMarkId": n, "Content": str(color)} for n in (1, 2)],
        })

    tables, sources, files = build(spark, {"o": [device(1), device(2)]})
    made = []
    real = analyze.materialize
    monkeypatch.setattr(analyze, "materialize", lambda df, name, **options: made.append(name) or real(df, name, **options))
    analysis = analyze.Analysis(tables, sources, ["owner"], files)
    candidates = analysis.note.extra["candidates"].select("NoteId", "UserMarkId").distinct().collect()
    assert sorted((r["NoteId"], r["UserMarkId"]) for r in candidates) == [(1, 1), (2, None)]
    assert {r["kind"]: r["n_candidates"] for r in analysis.conflicts_of("note").collect()} == {"note": 2}
    assert not {"mark-ranges", "mark-groups", "field-copies", "conflicts-userMark"} & set(made)
    kinds = [r["kind"] for r in analysis.conflicts.collect()]
    assert sorted(kinds) == ["note", "note", "userMark"] and made.count("conflicts-note") == made.count("mark-ranges") == 1


def test_equal_highlights_are_found_once_for_a_report(spark, monkeypatch):
    """Both checks on equal highlights and the ids in their samples read one table, and only sampled groups are numbered."""
    marks = [{"UserMarkId": n, "LocationId": 1, "UserMarkGuid": f"g{n}", "ColorIndex": n % 2} for n in range(1, 6)]
    tables, _, _ = build(spark, {"o": [source("Device", {
        "Location": [document(1, 5)], "UserMark": marks,
        "BlockRange": [{"BlockRangeId": n, "UserMarkId": n, "Identifier": 3} for n in range(1, 6)],
    })]})
    made = []
    real = health.materialize
    for module in (health, cleanup):
        monkeypatch.setattr(module, "materialize", lambda df, name, **options: made.append(name) or real(df, name, **options))
    report = {r["code"]: r for r in health.Health(tables, ["owner"]).report().where("code IN ('C4', 'C5')").collect()}
    assert report["C4"]["count"] == 3 and report["C5"]["count"] == 4
    assert any("#1, #3, #5" in s for s in report["C4"]["samples"]) and "#1, #2, #3, #4, #5" in report["C5"]["samples"][0]
    assert made.count("mark-prints") == made.count("styled-marks") == 1
