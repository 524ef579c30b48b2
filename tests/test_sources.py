"""Archive scan, manifests, admission, written snapshots; archives are made with the standard library."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from braidset import schema
from braidset.plans import finalize as fin
from braidset.plans.analyze import Analysis, IncompatibleSources
from braidset.plans.compatibility import schema_objects, table_exists
from braidset.sources.archives import read_archives
from braidset.sources.manifest import admit_files, media_inventory, parse_manifest
from braidset.sources.tables import build_manifest, collect_media, output_members, pick_thumbnail, read_snapshot, write_snapshot
from braidset.plans.validate import check_roundtrip, fingerprint
from rows import DEFAULTS, recording
from fleet import owner

def rich():
    """A device with rows in every table."""
    rows = owner(11, 1, 1.0)[0]["rows"]
    rows["Location"].append(recording(95, "talks", 3))
    rows["IndependentMedia"] = [{"IndependentMediaId": 6, "FilePath": "pic.png", "Hash": "cafe"}]
    rows["PlaylistItemAccuracy"] = [{"PlaylistItemAccuracyId": 2, "Description": "Rough"}]
    rows["PlaylistItem"] = [{"PlaylistItemId": 8, "Label": "Morning walk", "Accuracy": 2, "ThumbnailFilePath": "pic.png"}]
    rows["PlaylistItemIndependentMediaMap"] = [{"PlaylistItemId": 8, "IndependentMediaId": 6}]
    rows["PlaylistItemLocationMap"] = [{"PlaylistItemId": 8, "LocationId": 95, "BaseDurationTicks": 4200}]
    rows["PlaylistItemMarker"] = [{"PlaylistItemMarkerId": 4, "PlaylistItemId": 8, "StartTimeTicks": 60}]
    rows["PlaylistItemMarkerBibleVerseMap"] = [{"PlaylistItemMarkerId": 4, "VerseId": 19023001}]
    rows["PlaylistItemMarkerParagraphMap"] = [{"PlaylistItemMarkerId": 4, "MepsDocumentId": 77, "ParagraphIndex": 1}]
    rows["Tag"].append({"TagId": 70, "Type": 2, "Name": "Walks"})
    rows["TagMap"].append({"TagMapId": 900, "TagId": 70, "PlaylistItemId": 8, "Position": 0})
    return rows


SQL_TYPE = {"bigint": "INTEGER", "int": "INTEGER", "string": "TEXT"}


def database(tmp_path, name, rows, migrations=("v14", "v16"), without=None, stamp="2026-01-01T00:00:00Z"):
    file = tmp_path / f"{name}.db"
    con = sqlite3.connect(file)
    for table, ddl in schema.COLUMNS.items():
        columns = [c.strip().split(" ") for c in ddl.split(",")]
        kept = [c for c in columns if f"{table}.{c[0]}" != without]
        if table != without:
            con.execute(f'CREATE TABLE "{table}" ({", ".join(f"{c} {SQL_TYPE[t]}" for c, t in kept)})')
            names = [c for c, _ in kept]
            for row in rows.get(table, []):
                full = {**DEFAULTS.get(table, {}), **row}
                con.execute(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', [full.get(c) for c in names])
    con.execute("CREATE TABLE grdb_migrations (identifier TEXT)")
    con.executemany("INSERT INTO grdb_migrations VALUES (?)", [(m,) for m in migrations])
    con.execute("CREATE TABLE LastModified (LastModified TEXT)")
    con.execute("INSERT INTO LastModified VALUES (?)", (stamp,))
    con.execute("CREATE INDEX some_index ON Note (Guid)")
    con.execute("PRAGMA user_version = 16")
    con.commit()
    con.close()
    return file.read_bytes()


def archive(path, members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    path.write_bytes(buffer.getvalue())


def manifest(device, version=16, database_name="userData.db"):
    return json.dumps({"name": "n", "userDataBackup": {"deviceName": device, "schemaVersion": version, "databaseName": database_name}})


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("archives")
    work = tmp_path_factory.mktemp("work")
    rows = rich()
    archive(tmp / "a.zip", {"manifest.json": manifest("Phone"), "userData.db": database(work, "a", rows), "pic.png": b"PNG", "default_thumbnail.png": b"T",
                            "folder/deep.png": b"x"})
    archive(tmp / "b.zip", {"Manifest.JSON": manifest("", database_name="UserData.db"), "userdata.db": database(work, "b", rows)})
    archive(tmp / "c.zip", {"manifest.json": manifest("Short"), "userData.db": database(work, "c", rows, without="Note.Title")})
    archive(tmp / "d.zip", {"manifest.json": manifest("No table"), "userData.db": database(work, "d", rows, without="TagMap")})
    archive(tmp / "e.zip", {"other.txt": b"x"})
    archive(tmp / "f.zip", {"manifest.json": manifest("Broken"), "userData.db": b"this is no database" * 100})
    (tmp / "g.zip").write_bytes(b"no zip at all")
    archive(tmp / "h.zip", {"manifest.json": '{"userDataBackup": {"schemaVersion": "16"}}', "userData.db": database(work, "h", rows)})
    return read_archives(spark, f"{tmp}/*.zip")


def test_archives_become_tables(fleet):
    sources = {r["FileName"]: r for r in fleet["sources"].collect()}
    assert sorted(sources) == ["a.zip", "b.zip", "c.zip", "d.zip"]
    assert [sources[f]["src"] for f in sorted(sources)] == [0, 1, 2, 3]
    a, b = sources["a.zip"], sources["b.zip"]
    assert (a["DeviceName"], a["MigrationId"], a["UserVersion"], a["LastModified"]) == ("Phone", "v16", 16, "2026-01-01T00:00:00Z")
    assert b["DeviceName"] == "b.zip" and a["ok"] and b["ok"]
    for table in schema.TABLES:
        counts = {r["src"]: r["count"] for r in fleet["tables"][table].groupBy("src").count().collect()}
        assert counts == {0: len(rich()[table]), 1: len(rich()[table])}, table


def test_incomplete_databases_contribute_nothing(fleet):
    lacking = {r["FileName"]: (r["MissingTables"], r["MissingColumns"]) for r in fleet["sources"].where("NOT ok").collect()}
    assert lacking == {"c.zip": ([], ["Note.Title"]), "d.zip": (["TagMap"], [])}
    with pytest.raises(IncompatibleSources, match="Note.Title"):
        Analysis(fleet["tables"], fleet["sources"]).require_compatible()


def test_broken_archives_are_reported(fleet):
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in fleet["errors"].collect()}
    assert sorted(errors) == ["e.zip", "f.zip", "g.zip", "h.zip"]
    assert "no manifest" in errors["e.zip"] and "schemaVersion" in errors["h.zip"] and "database" in errors["f.zip"]


def test_members_and_objects(fleet):
    files = [(r["src"], r["path"]) for r in fleet["media_files"].collect()]
    assert files == [(0, "pic.png")]
    assert bytes(pick_thumbnail(fleet["thumbnails"], []).first()["content"]) == b"T"
    objects = {r["src"]: (r["tables"], r["indexes"], r["triggers"]) for r in schema_objects(fleet["objects"], ["src"]).collect()}
    assert objects[0] == (18, 1, 0) and objects[3] == (17, 1, 0)
    listing = fleet["objects"].where("type = 'table'").select("src", F.col("name").alias("table"))
    assert sorted(r["src"] for r in table_exists(listing, ["src"], "TagMap").collect()) == [0, 1, 2]


def test_archives_reconcile_and_write(spark, fleet, tmp_path):
    good = fleet["sources"].where("ok")
    analysis = Analysis(fleet["tables"], good, [], fleet["media_files"]).require_compatible()
    result = fin.finalize(analysis)
    write_snapshot(result.tables, f"{tmp_path}/out", [])
    back = read_snapshot(spark, f"{tmp_path}/out")
    trip = check_roundtrip(result.tables, back, []).collect()
    assert len(trip) == 16 and all(r["same"] for r in trip)
    assert sorted(map(str, fingerprint(result.tables, []).collect())) == sorted(map(str, fingerprint(back, []).collect()))
    media = collect_media(analysis.collected_media, fleet["media_files"], []).collect()
    assert [(r["FilePath"], bytes(r["content"])) for r in media] == [("pic.png", b"PNG")]
    assert [r["FilePath"] for r in output_members(analysis.collected_media, []).collect()] == ["pic.png"]
    made = build_manifest(analysis.compatibility, fingerprint(back, []), [], 1788706800000, device="  ").first()["manifest"]
    record = json.loads(made)
    assert record["userDataBackup"]["deviceName"] == "Merged (2 backups)" and len(record["userDataBackup"]["hash"]) == 64
    assert record["name"] == "UserdataBackup_2026-09-06_Merged.zip" and record["creationDate"] == "2026-09-06T15:00:00.0000000+00:00"


def test_manifest_defaults_and_errors(spark):
    texts = [
        "{bad", "[1]", '"text"', "{}", '{"userDataBackup": 3}', '{"userDataBackup": {"schemaVersion": "16"}}',
        '{"name": 5, "version": 2, "userDataBackup": {"schemaVersion": 16, "databaseName": "", "hash": null}}',
    ]
    rows = parse_manifest(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()
    assert [r["error"] for r in rows] == [
        "not valid JSON", "no userDataBackup", "not an object", "no userDataBackup", "no userDataBackup", "no numeric userDataBackup.schemaVersion", None,
    ]
    last = rows[-1]
    assert (last["name"], last["version"], last["type"], last["databaseName"], last["hash"], last["schemaVersion"]) == ("", 2, 0, "userData.db", "", 16)


def test_admission(spark):
    files = [(0, "a.zip", 5), (1, "a.ZIP", 5), (2, "a.zip", 5), (3, "a.txt", 5), (4, "b.zip", 0), (5, "c.zip", 3 * 1024**3), (6, "a.zip", 6)]
    got = admit_files(spark.createDataFrame(files, "i int, name string, size bigint"), ".zip", "i").orderBy("i").collect()
    assert [r["rejection"] for r in got] == [None, None, "already offered", "wrong suffix", "empty", "too large", None]


def test_inventory(spark):
    members = [(0, "m.png", b"x"), (0, "manifest.json", b"x"), (0, "userData.db", b"x"), (0, "default_thumbnail.png", b"x"), (0, "f/x.png", b"x")]
    df = spark.createDataFrame(members, "src int, path string, content binary").withColumn("databaseName", F.lit("userData.db"))
    assert [(r["path"], r["size"]) for r in media_inventory(df, ["src"]).collect()] == [("m.png", 1)]


def test_new_archives_are_handed_over_once(spark, tmp_path):
    from braidset.streaming.increment import on_new_archives

    folder, state, seen = tmp_path / "in", f"{tmp_path}/state", []
    folder.mkdir()
    handle = lambda batch, _: seen.append(sorted(r["path"].rsplit("/", 1)[1] for r in batch.collect()))
    archive(folder / "one.zip", {"a": b"1"})
    on_new_archives(spark, str(folder), state, handle)
    archive(folder / "two.zip", {"a": b"2"})
    on_new_archives(spark, str(folder), state, handle)
    assert [names for names in seen if names] == [["one.zip"], ["two.zip"]]
