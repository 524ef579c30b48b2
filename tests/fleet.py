"""Random owners with several devices, and a plain sequential model of what reconciling them must give.

An owner has a library of places, notes, highlights, fields, bookmarks and tags. Every device holds a random part of it under
its own local ids, and some of its texts, colours and slots were changed there.
"""

from __future__ import annotations

import random
from collections import defaultdict

from rows import document, place, publication, source

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty".split()


def _day(rng: random.Random) -> str:
    return f"2025-{rng.randrange(1, 5):02d}-{rng.randrange(1, 9):02d}T08:00:00Z"


def owner(seed: int, devices: int, share: float = 0.7) -> list[dict]:
    rng = random.Random(seed)
    library = [place(0, rng.randrange(1, 30), i + 1) for i in range(4)] + [document(0, 9000 + 7 * i + seed) for i in range(4)]
    shelves = [publication(0, f"shelf{i}") for i in range(2)]
    out = []
    for number in range(devices):
        pick = lambda things: [t for t in things if rng.random() < share]
        held = pick(range(len(library)))
        keys = rng.sample(range(1, 90), len(held) + len(shelves))
        places = {n: k for n, k in zip(held, keys)}
        rows: dict[str, list] = {"Location": [{**library[n], "LocationId": k} for n, k in places.items()]}
        rows["Location"] += [{**s, "LocationId": k} for s, k in zip(shelves, keys[len(held):])]
        rows["UserMark"], rows["BlockRange"], rows["Note"], rows["Bookmark"] = [], [], [], []
        for n in pick(held):
            mark = len(rows["UserMark"]) + 1 + 10 * number
            rows["UserMark"].append({"UserMarkId": mark, "LocationId": places[n], "UserMarkGuid": f"mark{n}", "ColorIndex": rng.choice((1, 1, 1, 4))})
            for identifier in sorted(rng.sample(range(1, 4), rng.choice((2, 2, 2, 1)))):
                rows["BlockRange"].append({"BlockRangeId": len(rows["BlockRange"]) + 1, "UserMarkId": mark, "Identifier": identifier})
        for n in pick(held):
            text = rng.choice((WORDS[n], WORDS[n], WORDS[n] + " " + rng.choice(WORDS)))
            padding = rng.choice(("", " ", "\r\n"))  # white space around a text is no edit
            rows["Note"].append({"NoteId": len(rows["Note"]) + 3 * number + 1, "Guid": f"note{n}", "LocationId": places[n], "Content": text + padding, "LastModified": _day(rng)})
        for n in pick(held):
            shelf = keys[len(held) + n % 2]
            rows["Bookmark"].append({"BookmarkId": len(rows["Bookmark"]) + 1, "LocationId": places[n], "PublicationLocationId": shelf, "Slot": len([b for b in rows["Bookmark"] if b["PublicationLocationId"] == shelf]), "Title": f"at {n}"})
        rows["InputField"] = [{"LocationId": places[n], "TextTag": "box", "Value": rng.choice(WORDS[:3])} for n in pick([n for n in held if n >= 4])]
        labels = pick(WORDS[:4])
        rows["Tag"] = [{"TagId": i + 1 + number, "Type": 1, "Name": w} for i, w in enumerate(labels)]
        rows["TagMap"] = []
        for tag in rows["Tag"]:
            for position, note in enumerate(pick(rows["Note"])):
                rows["TagMap"].append({"TagMapId": len(rows["TagMap"]) + 1, "TagId": tag["TagId"], "NoteId": note["NoteId"], "Position": position})
        out.append(source(f"Device{number}", rows, f"2026-0{rng.randrange(1, 4)}-01T00:00:00Z"))
    return out


FLEET = {f"owner{seed}": owner(seed, devices) for seed, devices in enumerate((1, 2, 2, 3, 3, 4, 5, 2))}
FLEET["twice"] = [FLEET["owner0"][0], {**FLEET["owner0"][0], "device": "Copy"}]


def natural(row: dict) -> tuple:
    """What tells a location apart in the data above."""
    return (row.get("BookNumber"), row.get("ChapterNumber"), row.get("DocumentId"), row["KeySymbol"])


def _latest(versions: list[tuple]) -> int:
    """Index of the version with the greatest time, the first one on ties."""
    return max(range(len(versions)), key=lambda i: (versions[i], -i))


def expected(sources: list[dict]) -> dict:
    """Rows of the result by natural keys, and which conflicts there are."""
    out: dict = {"places": set(), "tags": set(), "assigned": set(), "conflicts": set()}
    notes, marks, fields = defaultdict(list), defaultdict(list), defaultdict(list)
    slots: dict = {}
    for s in sources:
        rows = s["rows"]
        places = {r["LocationId"]: natural(r) for r in rows["Location"]}
        out["places"] |= set(places.values())
        guids = {r["NoteId"]: r["Guid"] for r in rows["Note"]}
        names = {r["TagId"]: r["Name"] for r in rows["Tag"]}
        out["tags"] |= set(names.values())
        out["assigned"] |= {(names[r["TagId"]], guids[r["NoteId"]]) for r in rows["TagMap"]}
        for r in rows["Note"]:
            notes[r["Guid"]].append((r["Content"].strip(), (r["LastModified"], s["stamp"])))
        for r in rows["UserMark"]:
            ranges = tuple(sorted(b["Identifier"] for b in rows["BlockRange"] if b["UserMarkId"] == r["UserMarkId"]))
            marks[r["UserMarkGuid"]].append(((r["ColorIndex"], ranges), (s["stamp"],)))
        for r in rows["InputField"]:
            fields[places[r["LocationId"]]].append((r["Value"], (s["stamp"],)))
        for r in rows["Bookmark"]:
            key = (places[r["PublicationLocationId"]], places[r["LocationId"]])
            if key not in slots:
                used = {v for (shelf, _), v in slots.items() if shelf == key[0]}
                slots[key] = r["Slot"] if r["Slot"] not in used else next(i for i in range(len(used) + 1) if i not in used)
    for kind, found in (("note", notes), ("userMark", marks), ("inputField", fields)):
        out[kind] = {}
        for key, versions in found.items():
            if len({v for v, _ in versions}) > 1:
                out["conflicts"].add((kind, str(key)))
                out[kind][key] = versions[_latest([t for _, t in versions])][0]
            else:
                out[kind][key] = versions[0][0]
    out["slots"] = slots
    return out
