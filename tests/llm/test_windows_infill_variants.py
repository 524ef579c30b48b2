"""Repeated windows of words, fill-in-the-middle and spelling variants against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from braidset.llm import infill, variants, windowcut
from braidset.llm.infill import Chunks, Outline, fill_in_middle, restored
from braidset.llm.variants import near_words, spelling_variants
from braidset.llm.windowcut import Words, repeated_windows, rolling
from test_text_operators import EDGES, words

SPACE = re.compile("[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- 11 repeated windows
def brute_windows(rows, size=20):
    split = [SPACE.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, split):
        for p in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[p:p + size])
                least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, split):
        gone, seen = [False] * len(w), set()
        for p in range(len(w) - size + 1):
            key = tuple(w[p:p + size])
            if key in seen or (i is not None and least[key] < i):
                gone[p:p + size] = [True] * size
            seen.add(key)
        spans = [(a, b) for a, b in zip([n for n in range(len(gone)) if gone[n] and not (n and gone[n - 1])],
                                        [n + 1 for n in range(len(gone)) if gone[n] and not (n + 1 < len(gone) and gone[n + 1])])]
        out.append((i, len(w), tuple(spans), " ".join(x for x, g in zip(w, gone) if not g).encode()))
    return Counter(out)


def cut(docs):
    return Counter((r["doc_id"], r["n_words"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in repeated_windows(docs).collect())


def test_windows_against_brute_force(documents):
    rng = random.Random(21)
    shared = [words(rng, 45) for _ in range(6)]
    rows = [(i, "  ".join([words(rng, 15), rng.choice(shared), words(rng, 9) + "\n", " ".join(rng.choice(shared).split()[rng.randrange(20):])])) for i in rng.sample(range(400), 80)]
    rows += [(500, "x " * 70), (501, "x " * 30), (502, " ".join([shared[0]] * 3)), (503, "ü ß é " * 12), (504, "ü ß é " * 12)]
    rows += [(rows[0][0], rows[1][1]), (rows[0][0], rows[0][1]), (None, rows[2][1]), (None, shared[0] + " " + shared[0]), *EDGES]
    assert cut(documents(rows)) == brute_windows(rows)
    assert cut(documents(rows).where("false")) == Counter()


def test_a_window_that_most_documents_share(documents):
    """One passage in every document, so that its names and windows are hot, between words of each document's own."""
    rng = random.Random(22)
    passage = words(rng, 30)
    rows = [(i, f"{words(rng, 12, 9000)} {passage} {words(rng, 12, 9000)}") for i in range(300)]
    assert cut(documents(rows)) == brute_windows(rows)


def test_pieces_do_not_change_hashes(monkeypatch):
    rng = random.Random(23)
    text = (words(rng, 3000) + " " + "y" * 5000 + " " + words(rng, 500)).encode()
    whole = Words([text])
    monkeypatch.setattr(windowcut, "PIECE", 1 << 12)
    parts = Words([text])
    longest = np.argmax(whole.end - whole.start)
    same = whole.hash == parts.hash
    assert same.sum() == len(same) - 1 and not same[longest]  # a word longer than a piece has a hash of its own kind
    monkeypatch.setattr(windowcut, "_STEP", 100)
    assert (rolling(parts.hash, 3, 8) == rolling(np.concatenate([parts.hash, parts.hash]), 3, 8)[:len(parts.hash) - 7]).all()
    assert len(set(rolling(parts.hash, 3, 8).tolist())) == len(parts.hash) - 7


# ---------------------------------------------------------------- 12 fill in the middle
def plain_infill(doc_id, text):
    text = text or ""
    seed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(seed[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_is_the_plain_rule_and_comes_back(documents):
    rng = random.Random(24)
    rows = [(i, "".join(rng.choice("ab <PSM>é€😀\n") for _ in range(rng.randrange(200)))) for i in range(300)]
    rows += [(400 + i, words(rng, 2000)) for i in range(12)] + [(500, rows[2][1]), (600, "<P"), (601, "x<M>"), (602, "<" * 50), (-7, "é" * 90_000), *EDGES]
    made = fill_in_middle(documents(rows))
    got = made.withColumn("again", restored(made["output"], made["form"])).collect()
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == Counter(plain_infill(*r) for r in rows)
    assert Counter((r["doc_id"], r["again"]) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} and fill_in_middle(documents(rows).where("false")).count() == 0


def test_chunks_follow_content_and_summaries_combine(monkeypatch):
    rng = random.Random(25)
    shared = words(rng, 4000).encode()
    chunks = Chunks()
    one, two = b"first " + shared, b"quite another beginning " + shared
    cut_one = {one[a:b] for a, b in zip([0, *chunks.boundaries(one)], chunks.boundaries(one))}
    cut_two = {two[a:b] for a, b in zip([0, *chunks.boundaries(two)], chunks.boundaries(two))}
    assert len(cut_one & cut_two) >= len(cut_one) - 2 > 3
    Outline(one, chunks)
    known = len(chunks.memo)
    Outline(two, chunks)
    assert len(chunks.memo) <= known + 2
    # Chunks of a byte or two: markers and characters lie across their boundaries.
    monkeypatch.setattr(infill, "AVERAGE", 2)
    monkeypatch.setattr(infill, "LONGEST", 2)
    for text in ("aé€😀" * 30, "x" * 40 + "<M>" + "y" * 40, "<P", "<<S>", "", "é"):
        raw = text.encode()
        outline = Outline(raw, Chunks())
        assert outline.points == len(text) and outline.marked == any(m in text for m in ("<P>", "<S>", "<M>"))
        assert [raw[outline.offset(p):] for p in range(len(text) + 1)] == [text[p:].encode() for p in range(len(text) + 1)]
    monkeypatch.setattr(infill, "_PIECE", 64)
    monkeypatch.setattr(infill, "AVERAGE", 16)
    monkeypatch.setattr(infill, "LONGEST", 1 << 15)
    pieces = Chunks().boundaries(one)
    monkeypatch.setattr(infill, "_PIECE", 1 << 20)
    assert pieces == Chunks().boundaries(one)


# ---------------------------------------------------------------- 13 spelling variants
def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, least=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    near = {w: [x for x in known if one_edit(w, x)] for w in known}
    form = {}
    for w, n in known.items():
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        form[w] = best if best is not None and known[best] >= 5 * n else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, n, len(near[w]), form[w], None if form[w] is None else known[form[w]], root(w)) for w, n in known.items()}


@pytest.mark.parametrize("symbols, crowded", [(8, 4096), (2, 4096), (2, 0), (8, 0)])
def test_variants_against_brute_force(documents, symbols, crowded):
    rng = random.Random(26)
    base = ["colour", "theatre", "analyse", "ÉTÉêtre", "aaaaaa", "aaaaaaa", "abababab", "straße"]
    def spelled(w):
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            k = rng.randrange(len(w))
            w = rng.choice((w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1:]))
        return w
    pool = [(w, 5 ** rng.randrange(1, 5)) for w in {spelled(rng.choice(base)) for _ in range(150)}]
    flat = [w for w, n in pool for _ in range(n)]
    rng.shuffle(flat)
    rows = [(i, " ".join(flat[i * 120:(i + 1) * 120]) + rng.choice((".", " 3x", "ÿ÷×"))) for i in range(len(flat) // 120 + 1)]
    rows += [(None, "Colour colour"), (None, None), (3, ""), (3, "colour"), (3, "colour"), (9999, "theatre " * 20_000)]
    got = {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants(documents(rows), symbols=symbols, crowded=crowded).collect()}
    want = plain_variants(rows)
    assert got == want and sum(w[3] is not None for w in want) > 5 and any(w[5] != w[3] and w[3] for w in want)


def test_variants_of_nothing(documents):
    assert spelling_variants(documents([(1, "one two three")])).count() == 0 and spelling_variants(documents([(1, None)]).where("false")).count() == 0


def test_near_pairs_come_once(spark):
    rng = random.Random(27)
    known = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(6, 8))) for _ in range(3000)})
    frame = spark.createDataFrame([(w, 5) for w in known], "word string, n long")
    got = [tuple(sorted((r["a"], r["b"]))) for r in near_words(frame).collect()]
    index = defaultdict(set)
    for w in known:
        for i in range(len(w)):
            index[w[:i] + w[i + 1:]].add(w)
    want = {tuple(sorted((a, b))) for k, group in index.items() for a in group for b in (group | ({k} if k in index or k in set(known) else set())) if b in set(known) and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
