"""Column functions against values worked out by hand."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import functions as F

from braidset.functions import hashing, keys as K, text as X, timestamps as TS
from braidset.plans.compatibility import migration_number


def evaluate(spark, values, column, ddl="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}").select("i", column(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_timestamps_normalise(spark):
    given = ["2031-08-22T19:45:07-0330", "2030-12-01T00:00:59.9871234+05:45", "2030-12-01T00:00:59.98Z", "2029-06-30 23:59:58", "\t2028-02-29T12:00:00Z "]
    assert evaluate(spark, given, TS.normalize_ts) == [
        "2031-08-22T19:45:07-03:30", "2030-12-01T00:00:59.987+05:45", "2030-12-01T00:00:59.98Z", "2029-06-30T23:59:58", "2028-02-29T12:00:00Z",
    ]


def test_timestamps_parse(spark):
    noon = int(datetime(2028, 2, 29, 12, tzinfo=timezone.utc).timestamp() * 1000)
    assert evaluate(spark, ["2028-02-29T12:00:00Z", "2028-02-29 12:00:00", "2028-02-29T17:45:00+05:45", "2028-02-29T12:00:00.000+00:00"], TS.parse_ts) == [noon] * 4
    assert evaluate(spark, ["soon", "", None, "2027-02-29T00:00:00Z", "28-2-9", "T12:00"], TS.parse_ts) == [None] * 6
    days = [int(datetime(*d, tzinfo=timezone.utc).timestamp() * 1000) for d in ((2031, 1, 1), (2031, 5, 1), (2031, 5, 6), (2031, 5, 6, 7, 8))]
    assert evaluate(spark, ["2031", "2031-05", "2031-05-06", "2031-05-06T07:08Z"], TS.parse_ts) == days


def test_keys_and_digests_as_columns(spark):
    row = spark.range(1).selectExpr("5 AS PublicationLocationId", "2 AS Slot", "1 AS Type", "'red' AS Name")
    got = row.select(K.bookmark_slot_key().alias("slot"), K.tag_key().alias("tag"), K.assignment_key(F.lit(7), F.lit("N"), F.lit(9)).alias("assigned"),
                     hashing.bytes_to_hex(F.lit(b"\x00\xfe")).alias("hex")).first()
    assert got["slot"].split(K.KEY_SEPARATOR) == ["5", "2"] and got["tag"].split(K.KEY_SEPARATOR) == ["1", "red"]
    assert got["assigned"].split(K.KEY_SEPARATOR) == ["7", "N", "9"] and got["hex"] == "00fe"
    guids = [r["g"] for r in spark.range(50).select(hashing.random_guid().alias("g")).collect()]
    assert len(set(guids)) == 50 and all(re.fullmatch("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", g) for g in guids)


def test_timestamps_order(spark):
    given = ["2026-01-01T00:00:00Z", "2025-12-31T23:59:59+00:00", "garbage", "zzz", "", None, "2024-01-02T10:00:00.000Z"]
    rows = spark.createDataFrame([(v,) for v in given], "v string").orderBy(TS.ts_key("v"), F.coalesce("v", F.lit("!"))).collect()
    assert [r["v"] for r in rows] == ["", None, "garbage", "zzz", "2024-01-02T10:00:00.000Z", "2025-12-31T23:59:59+00:00", "2026-01-01T00:00:00Z"]


def test_latest_text(spark):
    rows = spark.createDataFrame([(0, ""), (1, "2024-01-01T00:00:00Z"), (2, "2026-01-01T00:00:00Z"), (3, "2026-01-01T00:00:00+00:00"), (4, None)], "p int, v string")
    assert rows.agg(TS.latest_text("v", "p").alias("r")).first()["r"] == "2026-01-01T00:00:00Z"
    assert rows.where("p IN (0, 4)").agg(TS.latest_text("v", "p").alias("r")).first()["r"] == ""


def test_timestamp_output_forms(spark):
    assert evaluate(spark, [1783724180123], TS.format_utc, "bigint") == ["2026-07-10T22:56:20Z"]
    assert evaluate(spark, ["2026-07-10T22:56:20Z", "2026-07-10T22:56:20+01:00", ""], TS.offset_form) == ["2026-07-10T22:56:20+00:00", "2026-07-10T22:56:20+01:00", ""]
    assert evaluate(spark, [1783724180004], TS.iso_local, "bigint") == ["2026-07-10T22:56:20.0040000+00:00"]


def test_output_forms_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert evaluate(spark, [1783724180123], TS.format_utc, "bigint") == ["2026-07-10T22:56:20Z"]
        assert evaluate(spark, ["2024-01-02 03:04:05"], TS.parse_ts) == [1704164645000]
        assert evaluate(spark, [1783724180004], TS.iso_local, "bigint") == ["2026-07-10T18:56:20.0040000-04:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def _fnv(text: str, seed: int) -> int:
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        seed = ((seed ^ int.from_bytes(units[i:i + 2], "big")) * 16777619) & 0xFFFFFFFF
    return seed


def test_hashes(spark):
    texts = ["seed", "", "ä·世界", "pair \U0001F600 of units"]
    assert evaluate(spark, texts, hashing.fnv1a32) == [_fnv(t, 0x811C9DC5) for t in texts]
    assert _fnv("seed", 0x811C9DC5) == 1346747564
    guids = evaluate(spark, ["seed", "seed", "seed2"], hashing.stable_guid)
    assert guids[0] == guids[1] != guids[2]
    assert all(re.match(r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", g) for g in guids)
    words = [f"{_fnv('seed', s):08x}" for s in hashing.GUID_SEEDS]
    raw = "".join(words)
    flat = guids[0].replace("-", "")
    assert flat[:12] == raw[:12] and flat[13:16] == raw[13:16] and flat[17:] == raw[17:]


def test_text_normalises(spark):
    given = ["a\r\nb\rc", "  two\t\t words ", "x \n  y", "﻿　pad ", None, "line  end\n"]
    assert evaluate(spark, given, X.normalize_text) == ["a\nb\nc", "two words", "x\ny", "pad", "", "line end"]
    assert evaluate(spark, [None, "  ", "x"], X.is_blank) == [True, True, False]


def test_extensions(spark):
    names = ["a.b.png", "a1b2-0002", ".hidden", "dot.", "a\nb.c"]
    assert evaluate(spark, names, X.file_extension) == [".png", "", "", ".", ".c"]
    assert evaluate(spark, names, X.file_base) == ["a.b", "a1b2-0002", ".hidden", "dot", "a\nb"]


def test_sizes_and_counts(spark):
    assert evaluate(spark, [0, 1023, 1024, 1536, 102400, 5 * 1024**3, 3 * 1024**5, -1, None], X.format_bytes, "bigint") == [
        "0 B", "1023 B", "1.0 KB", "1.5 KB", "100 KB", "5.0 GB", "3145728 GB", "?", "?",
    ]
    assert evaluate(spark, [1, 0, 1234], lambda c: X.plural(c, "note"), "bigint") == ["1 note", "0 notes", "1,234 notes"]


def test_devices_and_colours(spark):
    given = ["My iPad mini", "Jo's iPhone", "stable", "MacBook Air", "tab 7", "Mac mini", None]
    assert evaluate(spark, given, X.device_kind) == ["tablet", "phone", "unknown", "desktop", "tablet", "desktop", "unknown"]
    assert evaluate(spark, [0, 6, 9], X.color_name, "int") == ["No colour", "Purple", "Colour 9"]
    assert evaluate(spark, [1, 9], X.color_hex, "int") == ["#fde047", "#9aa3b8"]


def test_keys_tell_null_from_empty(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), ("a", "null")], "x string, y string")
    assert rows.select(K.key_of("x", "y").alias("k")).distinct().count() == 3


def test_multisets_ignore_order_only(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "x"), (3, "x"), (3, "x"), (4, "x"), (4, "y"), (4, "y")], "g int, v string")
    prints = {r["g"]: r["k"] for r in rows.groupBy("g").agg(K.multiset_key(F.col("v")).alias("k")).collect()}
    assert prints[1] == prints[2] and len(set(prints.values())) == 3


def test_migration_numbers(spark):
    assert evaluate(spark, ["v16", "v9 ", "none", "", None, "a1b22"], migration_number) == [16, 9, -1, -1, -1, 22]


def test_word_changes(spark):
    rows = spark.createDataFrame([(1, "the old old text", "the new text"), (2, None, ""), (3, "same", "same")], "k int, a string, b string")
    got = {r["k"]: tuple(r)[1:] for r in X.text_change(rows, ["k"], "a", "b").collect()}
    assert got == {1: (1, 2, 2, 0.6), 2: (0, 0, 0, 0.0), 3: (0, 0, 1, 0.0)}
