"""Equal range sets are verified, not only fingerprinted; groups of copies are listed as rows."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from braidset.catalog import queries
from braidset.functions import keys as K
from braidset.plans import cleanup, validate
from braidset.plans.health import LISTED, Health
from braidset.session import MadeOnUse, materialize
from rows import build, document, source


def marks(spark, ranges: dict[int, list[int]], colors: dict[int, int] | None = None):
    """Highlights of one place with the given ranges (identifiers)."""
    rows = {
        "Location": [document(1, 5)],
        "UserMark": [{"UserMarkId": m, "LocationId": 1, "UserMarkGuid": f"g{m}", "ColorIndex": (colors or {}).get(m, 1)} for m in ranges],
        "BlockRange": [{"BlockRangeId": 100 * m + n, "UserMarkId": m, "Identifier": i} for m, held in ranges.items() for n, i in enumerate(held)],
        "Note": [{"NoteId": 1, "Guid": "n", "LocationId": 1, "UserMarkId": 3, "Content": "x"}],
    }
    tables, _, _ = build(spark, {"o": [source("Device", rows)]})
    return {t: df.drop("src") for t, df in tables.items()}


@pytest.mark.parametrize("forged", [False, True])
def test_sets_that_meet_by_chance_stay_apart(spark, monkeypatch, forged):
    """With fingerprints that tell nothing but the number of ranges, only really equal sets are one."""
    if forged:
        monkeypatch.setattr(K, "multiset_key", lambda *parts: F.concat(F.lit("x"), F.count("*").cast("string")))
    t = marks(spark, {1: [1, 2], 2: [2, 1], 3: [1, 2], 4: [1, 3], 5: [1, 1], 6: [2, 2], 7: [1, 1], 8: [9]})
    done = cleanup.apply_cleanups(t, ["owner"], {n: n == "duplicateHighlights" for n in cleanup.DEFAULTS})
    assert sorted(r["UserMarkId"] for r in done.tables["UserMark"].collect()) == [3, 4, 5, 6, 8]  # 3 has the note
    found = {(r["code"], r["count"]) for r in Health(t, ["owner"]).counts(["C3", "C4", "C5"]).collect()}
    assert found == {("C3", 3), ("C4", 3)}


def test_members_are_rows_and_samples_name_the_first(spark):
    t = marks(spark, {m: [4] for m in range(1, 41)}, {m: 2 for m in range(31, 41)})
    health = Health(t, ["owner"])
    members = [(r["code"], r["group"], r["nth"], r["UserMarkId"]) for r in health.members().collect()]
    assert sorted((n, m) for c, _, n, m in members if c == "C5") == [(m, m) for m in range(1, 41)]
    assert sorted((n, m) for c, _, n, m in members if c == "C4") == sorted([(m, m) for m in range(1, 31)] + [(m - 30, m) for m in range(31, 41)])
    samples = {r["code"]: r["samples"] for r in health.report(t["Location"].select("owner").distinct()).collect()}
    assert samples["C5"][0].endswith("#1, " + ", ".join(f"#{m}" for m in range(2, LISTED + 1)) + f" and {40 - LISTED} more)")
    assert len(samples["C4"]) == 8 and f"#{LISTED} and {30 - LISTED} more)" in samples["C4"][0]


def test_notes_go_from_clean_up_to_clean_up_unwritten(spark, monkeypatch):
    """What clean-ups did is known without writing texts of notes or ranges; a table that is read is written once."""
    t = marks(spark, {1: [1, 2], 2: [2, 1], 3: [1, 2], 4: [], 5: [1, 3]})
    made, real = [], cleanup.materialize
    monkeypatch.setattr(cleanup, "materialize", lambda df, name, **options: made.append(name) or real(df, name, **options))
    done = cleanup.apply_cleanups(t, ["owner"], {n: True for n in cleanup.DEFAULTS})
    assert {r["action"]: r["n"] for r in done.summary().collect()} == {"rangelessHighlights": 1, "duplicateHighlights": 2}
    assert {r["table"]: r["removed"] for r in done.removed().collect()} == {"UserMark": 3, "BlockRange": 4}
    assert not {"clean-Note", "clean-BlockRange", "clean-Location"} & set(made)
    for _ in range(2):
        assert [(r["NoteId"], r["UserMarkId"], r["Content"]) for r in done.tables["Note"].collect()] == [(1, 3, "x")]
        assert sorted(r["UserMarkId"] for r in done.tables["UserMark"].collect()) == [3, 5]
    assert made.count("clean-Note") == 1 and "clean-BlockRange" not in made


def test_damaged_tables_are_made_when_they_are_asked_for(spark, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(queries.derive, "damaged_tables", lambda spark, folder: MadeOnUse(["Note", "Tag"], lambda n: made.append(n) or spark.range(2)))
    tables = queries._damaged(spark, str(tmp_path))
    assert tables["Tag"].count() == 2 and tables["Tag"].count() == 2 and made == ["Tag"]
    assert queries._damaged(spark, str(tmp_path)) is tables and list(tables) == ["Note", "Tag"]


def test_references_are_counted_without_a_broadcast(spark):
    """Ids of a parent are sorted where references meet them, whatever the size of their file; dangling ones are counted by row."""
    t = marks(spark, {1: [1, 2], 2: [3]})
    t["BlockRange"] = t["BlockRange"].withColumn("UserMarkId", F.when(F.col("UserMarkId") == 1, 77).otherwise(F.col("UserMarkId")).cast("bigint"))
    found = validate.fk_violations(t, ["owner"])
    assert sorted((r["table"], r["column"], r["violations"]) for r in found.collect()) == [("BlockRange", "UserMarkId", 2), ("Note", "UserMarkId", 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    whole = {r["table"] + "." + r["column"]: r["violations"] for r in validate.fk_violations({n: df.drop("owner") for n, df in t.items()}, []).collect()}
    assert len(whole) == 20 and whole["BlockRange.UserMarkId"] == 2 and sum(whole.values()) == 3


def test_traces_meet_as_numbers(spark):
    """Rows without lineage, rows that are missing and rows of a losing copy that stayed are found; ids meet as numbers, nulls apart."""
    t = {n: df.withColumn("src", F.lit(0)) for n, df in marks(spark, {1: [1], 2: [2]}).items()}
    t["BlockRange"] = t["BlockRange"].unionByName(t["BlockRange"].limit(1).withColumn("BlockRangeId", F.lit(None).cast("bigint")))
    t["UserMark"] = t["UserMark"].unionByName(t["UserMark"].limit(1).withColumn("UserMarkId", F.lit(None).cast("bigint")))
    rows = [("o", 0, "BlockRange", "100", "mapped", "1", None), ("o", 0, "BlockRange", "200", "conflict", "2", "c"), ("o", 0, "BlockRange", K.NULL_TOKEN, "dropped", None, None),
            ("o", 0, "UserMark", "1", "mapped", "9", None), ("o", 0, "UserMark", None, "dropped", None, None)]
    lineage = spark.createDataFrame(rows, "owner string, src int, table string, local_key string, kind string, global_key string, conflict_id string")
    result = {n: df.limit(0).drop("src") for n, df in t.items()}
    result["BlockRange"] = t["BlockRange"].limit(1).drop("src").withColumn("BlockRangeId", F.lit(2).cast("bigint"))
    decisions = spark.createDataFrame([("o", "c", 1)], "owner string, conflict_id string, winner_src int")
    found = validate.check_traceability(t, lineage, result, decisions, ["owner"])
    assert {r["table"]: (r["untraced"], r["missing"], r["leaked"], r["dropped"]) for r in found.collect()} == {
        "Location": (1, 0, 0, 0), "Note": (1, 0, 0, 0), "UserMark": (2, 1, 0, 1), "BlockRange": (0, 1, 1, 1)}
    local, key, _ = validate._slim_keys("BlockRange")
    assert t["BlockRange"].select(*local).schema["_key"].dataType == lineage.select(*key).schema["_key"].dataType == t["BlockRange"].schema["BlockRangeId"].dataType


@pytest.mark.parametrize("given, while_writing", [("10485760b", "1048576"), ("256k", "262144"), ("-1", "-1")])
def test_only_small_sides_are_broadcast_for_stage_tables(spark, given, while_writing):
    name, rows, seen = "spark.sql.autoBroadcastJoinThreshold", spark.range(3), []
    write = lambda path: seen.append(spark.conf.get(name)) or rows.write.parquet(path)
    frame = SimpleNamespace(sparkSession=spark, schema=rows.schema, write=SimpleNamespace(options=lambda **o: SimpleNamespace(parquet=write)))
    before = spark.conf.get(name)
    spark.conf.set(name, given)
    try:
        assert materialize(frame, "small-sides").count() == 3 and seen == [while_writing] and spark.conf.get(name) == given
    finally:
        spark.conf.set(name, before)
