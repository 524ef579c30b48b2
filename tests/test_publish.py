"""Checked writing: refusal, split, one marker, proof of the contents read back."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from braidset import schema
from braidset.plans import finalize as fin
from braidset.plans.analyze import Analysis
from braidset.sources import publish as P
from braidset.streaming.increment import apply_batch
from fleet import FLEET
from rows import build

OWNER = [("owner", "string")]


@pytest.fixture(scope="module")
def sound(spark):
    tables, sources, files = build(spark, FLEET)
    return fin.finalize(Analysis(tables, sources, ["owner"], files)).tables


def lines(df):
    return sorted((r["owner"], r["table"], r["rule"], r["row_key"]) for r in df.collect())


def test_a_sound_result_is_published_once(spark, sound, tmp_path):
    root = str(tmp_path)
    assert P.publish(sound, root, 3, ["owner"]) is None and P.published(spark, root) == [3]
    assert P.publish({t: df.limit(0) for t, df in sound.items()}, root, 3, ["owner"]) is None  # a repeat does nothing
    proof = {r["table"]: r for r in P.prove_published(spark, root, 3, OWNER).collect()}
    assert set(proof) == set(schema.TABLES)
    assert all(r["same"] and r["contents"] and r["dangling"] == 0 and r["final"] == sound[t].count() for t, r in proof.items())
    back = P.read_published(spark, root, 3, OWNER)
    assert sorted(map(repr, back["Note"].collect())) == sorted(map(repr, sound["Note"].select(back["Note"].columns).collect()))


def test_broken_rows_stop_the_marker_and_are_named(spark, sound, tmp_path):
    note, mark = sound["Note"].orderBy("owner", "NoteId").first(), sound["UserMark"].orderBy("owner", "UserMarkId").first()
    block = sound["BlockRange"].where((F.col("owner") == mark["owner"]) & (F.col("UserMarkId") == mark["UserMarkId"]))
    broken = {
        **sound,
        "Note": sound["Note"].withColumn("BlockType", F.when((F.col("owner") == note["owner"]) & (F.col("NoteId") == note["NoteId"]), 7).otherwise(F.col("BlockType"))),
        "UserMark": sound["UserMark"].withColumn("LocationId", F.when(
            (F.col("owner") == mark["owner"]) & (F.col("UserMarkId") == mark["UserMarkId"]), 999_999).otherwise(F.col("LocationId")).cast("bigint")),
        "Tag": sound["Tag"].unionByName(sound["Tag"].where("TagId = 1").withColumn("TagId", F.lit(500).cast("bigint"))),
    }
    with pytest.raises(P.SnapshotRejected, match="writing table UserMark failed: 1 row") as refused:
        P.publish(broken, str(tmp_path), 1, ["owner"])
    assert P.published(spark, str(tmp_path)) == []
    found = lines(refused.value.rejects)
    assert (note["owner"], "Note", "block pair", str(note["NoteId"])) in found
    assert (mark["owner"], "UserMark", "LocationId refers to Location", str(mark["UserMarkId"])) in found
    assert {x[3] for x in found if x[1] == "Tag"} == {"500"} and {x[2] for x in found if x[1] == "Tag"} == {"unique name"}
    # Children of a rejected row go with it.
    assert {x[3] for x in found if x[1] == "BlockRange"} == {str(r["BlockRangeId"]) for r in block.collect()}

    again = P.publish(broken, str(tmp_path), 2, ["owner"], split=True)
    assert lines(again) == found and P.published(spark, str(tmp_path)) == [2]
    proof = P.prove_published(spark, str(tmp_path), 2, OWNER).collect()
    assert all(r["same"] and r["contents"] and r["dangling"] == 0 for r in proof)
    bad = len({(x[0], x[3]) for x in found if x[1] == "Note"})
    assert next(r["final"] for r in proof if r["table"] == "Note") == sound["Note"].count() - bad


def test_a_changed_cell_and_a_lost_row_are_found(spark, sound, tmp_path):
    root = str(tmp_path)
    P.publish(sound, root, 1, ["owner"])
    for table, change in (("Note", lambda d: d.withColumn("Title", F.when(F.col("NoteId") == 1, "x").otherwise(F.col("Title")))),
                          ("Location", lambda d: d.where("LocationId <> 1"))):
        folder = f"{root}/{P.marker(spark, root, 1)[table]['folder']}"
        rows = change(P.read_published(spark, root, 1, OWNER)[table]).collect()
        spark.createDataFrame(rows, P.read_published(spark, root, 1, OWNER)[table].schema).write.mode("overwrite").parquet(folder)
    proof = {r["table"]: (r["same"], r["contents"]) for r in P.prove_published(spark, root, 1, OWNER).collect()}
    assert {t for t, p in proof.items() if p != (True, True)} == {"Note", "Location"}
    assert proof["Note"] == (True, False) and proof["Location"] == (False, False)
    assert sum(r["dangling"] for r in P.prove_published(spark, root, 1, OWNER).collect()) > 0
    counts = {r["table"]: r["same"] for r in P.prove_published(spark, root, 1, OWNER, {"Tag": 10**6}).collect()}
    assert not counts["Tag"] and counts["Bookmark"]


def test_batches_are_applied_once(spark, sound, tmp_path):
    root, calls = str(tmp_path), []

    def change(current):
        calls.append(None if current is None else current["Bookmark"].count())
        return sound if current is None else {**current, "Bookmark": current["Bookmark"].where("BookmarkId > 1")}

    assert [apply_batch(spark, root, b, OWNER, change) for b in (0, 0, 1, 1, 0)] == [True, False, True, False, False]
    assert calls == [None, sound["Bookmark"].count()]
    assert P.read_published(spark, root, 1, OWNER)["Bookmark"].count() == sound["Bookmark"].where("BookmarkId > 1").count()
