"""All random owners reconciled at once, against the sequential model."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidset import schema
from braidset.plans import cleanup, finalize as fin, report, validate
from braidset.plans.analyze import Analysis, IncompatibleSources
from braidset.plans.health import Health, problems
from braidset.streaming.increment import merge_increment
from fleet import FLEET, expected, natural
from rows import build, document, source


class World:
    def __init__(self, spark):
        self.tables, self.sources, self.files = build(spark, FLEET)
        self.analysis = Analysis(self.tables, self.sources, ["owner"], self.files)
        self.result = fin.finalize(self.analysis)
        names = ("Location", "UserMark", "BlockRange", "Note", "Bookmark", "InputField", "Tag", "TagMap")
        self.rows = {t: [r.asDict() for r in self.result.tables[t].collect()] for t in names}

    def of(self, owner, table):
        return [r for r in self.rows[table] if r["owner"] == owner]


@pytest.fixture(scope="module")
def world(spark):
    return World(spark)


@pytest.mark.parametrize("owner", list(FLEET))
def test_result_is_the_model_s(world, owner):
    want = expected(FLEET[owner])
    places = {r["LocationId"]: natural(r) for r in world.of(owner, "Location")}
    assert Counter(places.values()) == Counter(want["places"])
    assert {r["Guid"]: r["Content"].strip() for r in world.of(owner, "Note")} == want["note"]
    ranges = {}
    for r in world.of(owner, "BlockRange"):
        ranges.setdefault(r["UserMarkId"], []).append(r["Identifier"])
    assert {r["UserMarkGuid"]: (r["ColorIndex"], tuple(sorted(ranges.get(r["UserMarkId"], [])))) for r in world.of(owner, "UserMark")} == want["userMark"]
    assert {places[r["LocationId"]]: r["Value"] for r in world.of(owner, "InputField")} == want["inputField"]
    assert {(places[r["PublicationLocationId"]], places[r["LocationId"]]): r["Slot"] for r in world.of(owner, "Bookmark")} == want["slots"]
    names, guids = {r["TagId"]: r["Name"] for r in world.of(owner, "Tag")}, {r["NoteId"]: r["Guid"] for r in world.of(owner, "Note")}
    assert sorted(names.values()) == sorted(want["tags"])
    assigned = [(names[r["TagId"]], guids[r["NoteId"]]) for r in world.of(owner, "TagMap")]
    assert sorted(assigned) == sorted(want["assigned"])
    assert len({(r["TagId"], r["Position"]) for r in world.of(owner, "TagMap")}) == len(assigned)


def test_conflicts_are_the_model_s(world):
    found = Counter((r["owner"], r["kind"]) for r in world.analysis.conflicts.collect())
    want = Counter((owner, kind) for owner in FLEET for kind, _ in expected(FLEET[owner])["conflicts"])
    assert found == want and len(want) > 6


def test_every_row_is_traced_and_every_rule_met(world):
    trace = validate.check_traceability(world.tables, world.analysis.lineage, world.result.tables, world.result.decisions, ["owner"])
    assert all(r["untraced"] == 0 and r["missing"] == 0 and r["leaked"] == 0 for r in trace.collect())
    for check in (validate.fk_violations, validate.constraint_violations, validate.unique_violations):
        assert not [r for r in check(world.result.tables, ["owner"]).collect() if r["violations"]]
    counts = validate.reconcile_counts(
        report.source_counts(world.analysis), report.dropped_counts(world.analysis), fin.table_counts(world.result.tables, ["owner"]), None, ["owner"])
    assert all(r["ok"] for r in counts.collect())


def test_a_lost_or_foreign_row_is_noticed(spark, world):
    lost = {**world.result.tables, "Note": world.result.tables["Note"].where("owner <> 'owner3' OR NoteId > 1")}
    trace = validate.check_traceability(world.tables, world.analysis.lineage, lost, world.result.decisions, ["owner"]).collect()
    assert sum(r["missing"] for r in trace) > 0
    dangling = validate.fk_violations({**world.result.tables, "Location": world.result.tables["Location"].where("LocationId > 1")}, ["owner"]).collect()
    assert sum(r["violations"] for r in dangling) > 0


def test_keeping_both_keeps_every_version(world):
    choices = world.analysis.conflicts.selectExpr("owner", "conflict_id", "-1 AS choice")
    both = fin.finalize(world.analysis, choices)
    before = Counter(r["owner"] for r in world.rows["Note"])
    after = Counter(r["owner"] for r in both.tables["Note"].collect())
    versions = {r["owner"]: 0 for r in world.rows["Note"]}
    for r in world.analysis.conflicts.where("kind = 'note'").collect():
        versions[r["owner"]] += r["n_candidates"] - 1
    assert all(after[o] - before[o] == n for o, n in versions.items())


def test_clean_ups_leave_a_sound_result(world):
    clean = cleanup.apply_cleanups(world.result.tables, ["owner"])
    assert not [r for r in validate.fk_violations(clean.tables, ["owner"]).collect() if r["violations"]]
    used = {(r["owner"], r[c]) for t, c in (("Note", "LocationId"), ("UserMark", "LocationId"), ("InputField", "LocationId"), ("Bookmark", "LocationId"), ("Bookmark", "PublicationLocationId"))
            for r in clean.tables[t].collect() if r[c] is not None}
    left = {(r["owner"], r["LocationId"]) for r in clean.tables["Location"].collect()}
    assert left <= used
    serious = problems(Health(clean.tables, ["owner"], world.files.limit(0)).report(world.sources.select("owner").distinct())).collect()
    assert not serious  # duplicates are merged, everything unused is gone
    assert sum(r["count"] for r in Health(clean.tables, ["owner"]).counts(["C4"]).collect()) == 0


def test_reports_before_and_after_building(spark, world):
    seen = report.analysis_report(world.analysis)
    assert {r["owner"]: r["n_tables"] for r in seen["sources"].collect()}.keys() == set(FLEET)
    assert seen["conflicts"].count() == world.analysis.conflicts.count() and seen["compatibility"].where("NOT ok").isEmpty()
    assert {r["owner"]: r["n"] for r in seen["counts"].where("table = 'Note'").collect()} == Counter(r["owner"] for r in world.rows["Note"])
    clean = cleanup.apply_cleanups(world.result.tables, ["owner"])
    built = report.build_report(world.analysis, world.result, clean, clean.tables)
    assert all(r["ok"] and not r["errors"] and not r["rules_broken"] for r in built["validation"].collect())
    assert built["rules"].isEmpty() and built["decisions"].count() == world.result.decisions.count()
    # A changed text, a lost note and a broken rule are in the verdict of their owner alone.
    bad = {**clean.tables, "Note": clean.tables["Note"].where("owner <> 'owner3' OR NoteId > 1").withColumn(
        "Title", F.when(F.col("owner") == "owner4", "other").otherwise(F.col("Title"))).withColumn("BlockType", F.when(F.col("owner") == "owner5", 9).otherwise(F.col("BlockType")))}
    verdicts = {r["owner"]: r for r in report.build_report(world.analysis, world.result, clean, bad)["validation"].collect()}
    assert {o for o, r in verdicts.items() if not r["ok"]} == {"owner3", "owner4", "owner5"}
    assert verdicts["owner5"]["rules_broken"] == 1 and verdicts["owner4"]["tables_changed"] == 1 and verdicts["owner4"]["rules_broken"] == 0
    assert any("rows written" in e for e in verdicts["owner3"]["errors"])


def test_merging_again_adds_nothing(spark, world):
    about = world.sources.where("src = 0").selectExpr("owner", "src", "FileName", "'Merged' AS DeviceName", "SchemaVersion", "MigrationId", "UserVersion", "'2030-01-01T00:00:00Z' AS LastModified")
    again = fin.finalize(merge_increment(world.result.tables, about, world.tables, world.sources, ["owner"], world.files.limit(0)))
    for table in ("Location", "Note", "UserMark", "Tag", "TagMap", "Bookmark", "InputField"):
        assert Counter(r["owner"] for r in again.tables[table].collect()) == Counter(r["owner"] for r in world.rows[table]), table


def test_incompatible_owners_are_refused_with_the_whole_report(spark):
    sets = {f"o{i}": [source("Left", {"Location": [document(1, 5)]}), source("Right", {"Location": [document(1, 5)]}, version=15)] for i in range(25)}
    tables, sources, _ = build(spark, sets)
    with pytest.raises(IncompatibleSources, match="schema versions differ") as refused:
        Analysis(tables, sources, ["owner"])
    assert refused.value.report.count() == 25
    with pytest.raises(IncompatibleSources, match="no sources"):
        Analysis({}, sources.where("false"), ["owner"])


def test_schema_names_every_table(world):
    assert set(world.result.tables) == set(schema.TABLES)
