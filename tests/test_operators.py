"""Generic operators against plain Python, with one key holding a third of the rows and more."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from braidset.operators.conflicts import suggest_winner, update_resolutions
from braidset.operators.match import match_by_key, match_multi_key, number_entities
from braidset.operators.ordinals import global_ordinal, ordinal_within, top_rows
from braidset.operators.positions import append_positions, fill_slots, rename_collisions
from braidset.functions.timestamps import ts_key


def skewed_rows(n, seed):
    rng = random.Random(seed)
    return [(src, src * 10_000 + i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}") for src in range(3) for i in range(n) if rng.random() < 0.8]


def test_ordinals(spark):
    rows = skewed_rows(300, 1)
    df = spark.createDataFrame(rows, "src int, pk int, key string").repartition(5)
    got = {r["pk"]: r["n"] for r in global_ordinal(df, ["src", "pk"], "n").collect()}
    assert got == {pk: i + 1 for i, (_, pk, _) in enumerate(sorted(rows))}
    expected, seen = {}, {}
    for src, pk, key in sorted(rows):
        seen[key] = seen.get(key, 0) + 1
        expected[pk] = seen[key]
    assert {r["pk"]: r["n"] for r in ordinal_within(df, ["key"], ["src", "pk"], "n").collect()} == expected


def test_hot_groups_are_spread(spark):
    """The rows of one key end up in many partitions of the numbering sort."""
    df = spark.range(20_000).selectExpr("id AS pk", "if(id >= 0, 'hot', 'cold') AS key")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows stay together
    try:
        parts = ordinal_within(df, ["key"], ["pk"], "n", keep_part=True).groupBy("_ord_part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 10_000


def test_occurrence_match(spark):
    rows = skewed_rows(200, 2)
    index, expected, creators = {}, {}, []
    for src, pk, key in sorted(rows):
        entry = next((e for e in index.setdefault(key, []) if src not in e[1]), None)
        if entry is None:
            creators.append((src, pk))
            entry = (len(creators), set())
            index[key].append(entry)
        entry[1].add(src)
        expected[src, pk] = entry[0]
    df = spark.createDataFrame(rows, "src int, pk int, key string")
    got = number_entities(match_by_key(df, [], "key"), []).collect()
    assert {(r["src"], r["pk"]): r["gid"] for r in got} == expected


def test_multi_key_match(spark):
    """Several keys per row, against the rule walked row by row."""
    rng = random.Random(3)
    rows = []
    for src in range(4):
        places, recordings = rng.sample(range(30), 18), rng.sample(range(30), 18)
        for pk in range(18):
            t = f"t{places[pk]}" if rng.random() < 0.6 else None
            m = f"m{recordings[pk]}" if rng.random() < 0.6 else None
            rows.append((src, pk + 100 * src, t, m, f"f{t}/{m}" if t or m else f"plain{rng.randrange(4)}"))
    index, expected, n = {}, {}, 0
    for src, pk, *keys in sorted(rows, key=lambda r: r[:2]):
        live = [k for k in keys if k]
        gid = next((e[0] for k in live for e in index.get(k, []) if src not in e[1]), None)
        if gid is None:
            n += 1
            gid = n
        for k in live:
            entry = next((e for e in index.setdefault(k, []) if e[0] == gid), None)
            if entry is None:
                entry = (gid, set())
                index[k].append(entry)
            entry[1].add(src)
        expected[src, pk] = gid
    df = spark.createDataFrame(rows, "src int, pk int, t string, m string, f string")
    got = number_entities(match_multi_key(df, [], "t", "m", "f"), []).collect()
    assert {(r["src"], r["pk"]): r["gid"] for r in got} == expected


@pytest.mark.parametrize("sorted_rows", [100_000, 7])
def test_crowded_groups_are_numbered_alike(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr("braidset.operators.ordinals.SORTED", sorted_rows)
    rng = random.Random(12)
    rows = [("hot" if i % 3 else f"g{rng.randrange(40)}", i * 7 % 601, i) for i in range(600)]
    got = {r["i"]: r["n"] for r in ordinal_within(spark.createDataFrame(rows, "g string, o int, i int"), ["g"], ["o"], "n").collect()}
    for g in {r[0] for r in rows}:
        assert [got[i] for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])] == list(range(1, sum(r[0] == g for r in rows) + 1))


def walked(rows):
    """The multi-key rule row by row: entity (src, pk) of every row."""
    known, out = {}, {}
    for src in sorted({r[0] for r in rows}):
        mine = [r for r in sorted(rows, key=lambda r: r[:2]) if r[0] == src]
        for r in mine:
            out[r[:2]] = next((known[k] for k in r[2:] if k in known), r[:2])
        for r in mine:
            for k in r[2:]:
                if k is not None:
                    known.setdefault(k, out[r[:2]])
    return out


@pytest.mark.parametrize("sources, streamed", [(40, 200_000), (8, 4)])
def test_many_sources_in_one_component(spark, sources, streamed):
    """Sources whose rows are tied by keys in turn, beside small components; all streamed, and the large one in rounds."""
    rng = random.Random(8)
    rows = []
    for src in range(sources):
        rows.append((src, 1, f"t{src // 2}", f"m{(src + 1) // 2}", f"f{src}"))
        if src % 3 == 0:
            k = rng.randrange(5)
            rows.append((src, 2, f"s{k}", f"r{rng.randrange(3)}-{src % 2}", f"g{src}"))
        rows.append((src, 3, None, None, f"plain{rng.randrange(4)}"))
    want = walked([r for r in rows if r[1] != 3])
    df = spark.createDataFrame([("a", *r) for r in rows], "owner string, src int, pk bigint, t string, m string, f string")
    got = {(r["src"], r["pk"]): (r["ent_src"], r["ent_pk"]) for r in match_multi_key(df, ["owner"], "t", "m", "f", streamed).where("pk < 3").collect()}
    assert got == want and len(set(want.values())) > 2


def test_jobs_do_not_grow_with_sources(spark):
    def jobs(sources):
        rows = [(src, pk, f"t{pk}-{src // 2}", f"m{pk}-{(src + 1) // 2}", f"f{pk}-{src}") for src in range(sources) for pk in range(3)]
        df = spark.createDataFrame(rows, "src int, pk bigint, t string, m string, f string")
        spark.sparkContext.setJobGroup(f"sources{sources}", "count the jobs")
        match_multi_key(df, [], "t", "m", "f").collect()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sources{sources}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    few, many = jobs(4), jobs(16)
    assert many < 2.5 * few  # with four times the sources; rounds of contraction follow the logarithm of a chain's length


def place_all(rows):
    used, out = {}, {}
    for src, pk, pub, slot in sorted(rows):
        taken = used.setdefault(pub, set())
        if slot in taken:
            slot = next(i for i in range(len(taken) + 1) if i not in taken)
        taken.add(slot)
        out[src, pk] = slot
    return out


def test_slots_in_small_and_big_groups(spark):
    rng = random.Random(4)
    rows = [(src, pk, "hot" if pk % 3 else f"p{pk % 12}", rng.choice([rng.randrange(12), rng.randrange(400)])) for src in range(3) for pk in range(120)]
    rows += [(0, 500 + i, "all different", i) for i in range(5)]
    df = spark.createDataFrame(rows, "src int, pk int, pub string, Slot int")
    expected = place_all(rows)
    assert {(r["src"], r["pk"]): r["new_slot"] for r in fill_slots(df, ["pub"]).collect()} == expected


def test_slots_below_zero_and_far_away(spark):
    rng = random.Random(14)
    rows = [(0, 1, "p", -3), (0, 2, "p", 5), (0, 3, "p", 5)]
    rows += [(src, pk, f"q{pk % 5}", rng.choice([-2, -1, 0, 1, 2, 2**31 - 1])) for src in range(3) for pk in range(60)]
    got = fill_slots(spark.createDataFrame(rows, "src int, pk int, pub string, Slot int"), ["pub"]).collect()
    assert {(r["src"], r["pk"]): r["new_slot"] for r in got} == place_all(rows)


def test_positions_of_a_hot_tag(spark):
    rng = random.Random(5)
    rows = []
    for tag in ("hot", "t1", "t2"):
        for i in range(150 if tag == "hot" else 10):
            rows.append((tag, i, rng.randrange(-20, 60), i % 3 == 0))
    rows += [("below", i, p, True) for i, p in enumerate((-5, -5, 0, -3))] + [("below", 9, 7, False)]
    expected = {}
    for tag in ("hot", "t1", "t2", "below"):
        top, used = -1, set()
        mine = sorted((p, i) for t, i, p, first in rows if t == tag and first)
        for p, i in mine:
            pos = p if p not in used else top + 1
            used.add(pos)
            top = max(top, pos)
            expected[tag, i] = pos
        for p, i in sorted((p, i) for t, i, p, first in rows if t == tag and not first):
            top += 1
            expected[tag, i] = top
    df = spark.createDataFrame(rows, "tag string, i int, Position int, first_contributor boolean")
    got = append_positions(df, ["tag"], ["Position", "i"]).collect()
    assert {(r["tag"], r["i"]): r["new_position"] for r in got} == expected


def test_renamed_paths_stay_unique(spark):
    rows = [(i, f"h{i % 3}", ["a.png", "A.PNG", "b", "b"][i % 4]) for i in range(1, 41)]
    got = rename_collisions(spark.createDataFrame(rows, "gid int, Hash string, FilePath string"), []).collect()
    assert len(got) == 40 and len({r["new_path"].lower() for r in got}) == 40
    firsts = {}
    for gid, _, path in rows:
        firsts.setdefault(path.lower(), gid)
    assert sorted(r["gid"] for r in got if not r["renamed"]) == sorted(firsts.values())
    assert all(r["new_path"].lower().endswith(".png") for r in got if r["FilePath"].lower().endswith(".png"))


def fold(candidates, by_row):
    best, decided = candidates[0], "tie"
    for c in candidates[1:]:
        a, b = ((c[2], c[3]), (best[2], best[3])) if by_row else ((c[3],), (best[3],))
        basis = ("row" if a[0] != b[0] else "backup") if by_row else "snapshot"
        if a > b:
            best, decided = c, basis
        elif a < b and decided == "tie":
            decided = basis
    return best[0], decided


def test_suggested_winner(spark):
    rng = random.Random(6)
    groups = {f"c{i}": [(s, s, rng.randrange(3), rng.randrange(3)) for s in range(rng.randrange(2, 6))] for i in range(120)}
    flat = [(cid, s, pk, f"S{s}", f"2025-01-0{r + 1}T00:00:00Z", f"2026-01-0{b + 1}T00:00:00Z") for cid, cs in groups.items() for s, pk, r, b in cs]
    df = spark.createDataFrame(flat, "cid string, src int, pk int, label string, r string, b string").withColumns({"row_ts": ts_key("r"), "backup_ts": ts_key("b")})
    for by_row in (True, False):
        got = {r["cid"]: (r["suggested_src"], r["decided_by"]) for r in suggest_winner(df, ["cid"], by_row).collect()}
        assert got == {cid: fold(cs, by_row) for cid, cs in groups.items()}


def test_resolution_edits(spark):
    now = spark.createDataFrame([("a", 0), ("b", 1)], "conflict_id string, choice int")
    edits = spark.createDataFrame([("a", 2, 1), ("a", None, 2), ("b", 0, 1), ("c", -1, 1)], "conflict_id string, choice int, seq int")
    assert {tuple(r) for r in update_resolutions(now, edits, []).collect()} == {("b", 0), ("c", -1)}


def test_top_rows_are_pruned_before_the_shuffle(spark):
    df = spark.range(10_000).selectExpr("if(id >= 0, 'hot', 'cold') AS g", "id")
    top = top_rows(df, ["g"], [F.col("id")], 3)
    assert [r["id"] for r in top.orderBy("id").collect()] == [0, 1, 2]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_highlight_copies_agree_iff_their_ranges_do(spark):
    """Repeated and missing ranges, null tokens: conflict where the multisets differ; numbers of equal ranges pair the copies."""
    from braidset.plans.analyze import Analysis
    from rows import build, document, source

    held = {  # guid: ranges (start) of the copy on each device
        "same": ([1, 1, None], [None, 1, 1], [1, None, 1]), "often": ([1, 1, 2], [1, 2, 2], [1, 1, 2]), "less": ([1, 2], [1], [1, 2]),
        "bare": ([], [], []), "one": ([], [5], []), "null": ([None], [3], [None]),
    }
    devices = []
    for d in range(3):
        marks = [{"UserMarkId": 10 * d + i, "LocationId": 1, "UserMarkGuid": g} for i, g in enumerate(held)]
        ranges = [(10 * d + i, start) for i, copies in enumerate(held.values()) for start in copies[d]]
        devices.append(source(f"D{d}", {"Location": [document(1, 1)], "UserMark": marks, "BlockRange": [
            {"BlockRangeId": 100 * d + n, "UserMarkId": m, "Identifier": 7, "StartToken": t} for n, (m, t) in enumerate(ranges)]}))
    tables, sources, files = build(spark, {"o": devices})
    a = Analysis(tables, sources, ["owner"], files)
    assert {r["guid"] for r in a.user_mark.extra["groups"].where("is_conflict").collect()} == {"often", "less", "one", "null"}
    assert a.merged("BlockRange").count() == 3
    paired = a.block_range.ids.where("kind = 'mapped'").groupBy("gid").count().collect()
    assert sorted(r["count"] for r in paired) == [3, 3, 3] and not a.block_range.ids.where("kind = 'dropped'").count()
    # The equal ranges are numbered where they are read: the stage table has the numbers, one for every occurrence.
    numbers = a._mark_ranges.where("StartToken = 1 AND src = 0").join(a.user_mark.extra["groups"].where("guid = 'same'").select("owner", "gid"), ["owner", "gid"])
    assert sorted(r["nth"] for r in numbers.collect()) == [1, 2]
