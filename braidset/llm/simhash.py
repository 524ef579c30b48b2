"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are cut into parts: two of 32 bits for up to 3 differing bits, four of 16 for up to 11. Two
fingerprints within the threshold then differ in at most t = 1 (or 2) bits of some part. The anchors of a part are the words of a
covering code: a perfect Hamming code ([31, 26] or [15, 11], covering radius 1) times the one bit left. A fingerprint lives
at its nearest anchor (distance 1 at most) and is replicated to every anchor within covering radius plus t, so that
every linked pair meets at the anchor where one of them lives; each anchor compares its residents with its
visitors on all 64 bits. Two parts have 2^27 anchors each and stay selective for billions of fingerprints; four parts have 2^12
each, so beyond some millions of fingerprints their comparisons grow with the square (see the README).

``neartexts`` finds near copies by their sets of shingles on the same anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from braidset.llm.common import components
from braidset.session import materialize

THRESHOLD = 3
#: Residents of one anchor that are compared in one group; larger anchors are split into blocks.
BLOCK = 512
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; none for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    parts = _WORDS.findall(raw)
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    lasts = ends[words - 1:] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), lasts.tolist())], "<u8")


def simhash(text: str | None, words: int = 3) -> int:
    """Fingerprint of a text: bit b is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    hashes = _shingle_hashes(text, words, 42)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            found = np.fromiter((simhash(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long, 0 for texts without a word."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda batches: _fingerprint_batches(batches, words), f"doc_id {kind}, fp long")


class Anchors:
    """The covering code of one part of a fingerprint: a Hamming code on all but the top bit, times that bit."""

    def __init__(self, width: int, reach: int) -> None:
        self.width, n = width, width - 1
        bits = [1 << (i - 1) for i in range(1, n + 1)]
        self.syndrome = np.zeros((-(-width // 8), 256), np.uint32)
        for byte in range(len(self.syndrome)):
            for value in range(256):
                for bit in range(8):
                    if value >> bit & 1 and byte * 8 + bit < n:
                        self.syndrome[byte, value] ^= byte * 8 + bit + 1
        # Flips of two and three bits by their syndrome; with the nearest word they are all words within distance 3.
        two: list[list[int]] = [[] for _ in range(n + 1)]
        three: list[list[int]] = [[] for _ in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(i + 1, n + 1):
                two[i ^ j].append(bits[i - 1] | bits[j - 1])
                for k in range(j + 1, n + 1) if reach > 2 else ():
                    three[i ^ j ^ k].append(bits[i - 1] | bits[j - 1] | bits[k - 1])
        self.flips = [np.array(f, np.uint32) for f in two]
        self.far = [np.array([*f, *g], np.uint32) for f, g in zip(two, three)] if reach > 2 else self.flips
        self.reach = reach

    def home(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest anchor of each part, and its syndrome."""
        s = np.zeros(len(part), np.uint32)
        for byte in range(len(self.syndrome)):
            s ^= self.syndrome[byte][(part >> np.uint32(8 * byte)) & np.uint32(255)]
        return part ^ np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32), s

    def visits(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) of all other anchors within ``reach``; the top bit may differ as one of the bits."""
        home, s = self.home(part)
        top = np.uint32(1 << (self.width - 1))
        rows, anchors = [np.arange(len(part))], [home ^ top]
        for value in np.unique(s):
            at = np.flatnonzero(s == value)
            for flips, other in ((self.far[value], np.uint32(0)), (self.flips[value] if self.reach > 2 else self.flips[0], top)):
                rows.append(np.repeat(at, len(flips)))
                anchors.append((part[at][:, None] ^ flips[None, :] ^ other).ravel())
        return np.concatenate(rows), np.concatenate(anchors)


def _parts(threshold: int) -> tuple[int, int]:
    """How many parts, and how far from an anchor its visitors may be."""
    if threshold > 11:
        raise ValueError("the anchors cover at most 11 differing bits")
    return (2, 2) if threshold <= 3 else (4, 3)


def _replicas(batches: Iterator[pa.RecordBatch], threshold: int, visiting: bool) -> Iterator[pa.RecordBatch]:
    number, reach = _parts(threshold)
    width = 64 // number
    code = Anchors(width, reach)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 10_000):
            chunk = fp[at:at + 10_000]
            for i in range(number):
                part = ((chunk >> np.uint64(width * i)) & np.uint64((1 << width) - 1)).astype(np.uint32)
                row, anchor = code.visits(part) if visiting else (np.arange(len(part)), code.home(part)[0])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64) | i << 40), pa.array(chunk[row].view(np.int64))], ["anchor", "fp"])


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the pairs that join two parts not joined by the pairs before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def _linked(residents: np.ndarray, visitors: np.ndarray, same: bool, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    found = ([], [])
    step = max(1, (1 << 20) // max(1, len(residents)))
    for at in range(0, len(visitors), step):
        bits = np.bitwise_count(visitors[at:at + step, None] ^ residents[None, :])
        v, r = np.nonzero(bits <= threshold)
        a, b, bits = visitors[at:at + step][v], residents[r], bits[v, r]
        keep = a < b if same else a != b
        near = np.argsort(bits[keep], kind="stable")  # the closest first, so that the forest keeps those
        a, b = a[keep][near], b[keep][near]
        kept = _forest(a, b)
        found[0].append(a[kept])
        found[1].append(b[kept])
    return np.concatenate(found[0]), np.concatenate(found[1])


def _compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links of each group of a partition sorted by group and role, as a forest per step.

    Memory holds one group's residents (``BLOCK`` on average at most) and one batch of rows; the
    group that a batch ends in is carried over by its residents alone.
    """
    open_key: tuple[int, ...] | None = None
    residents = np.zeros(0, np.uint64)
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(cols[0]):
            continue
        fp = cols[4].view(np.uint64)
        cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
        homes = np.concatenate([[0], np.cumsum(cols[3] == 0)])
        homes = homes[ends] - homes[starts]
        first = tuple(int(c[0]) for c in cols[:3])
        busy = np.flatnonzero(((homes > 0) & (ends - starts > 1)) | (np.arange(len(starts)) == 0) | (ends == len(fp)))
        out_a, out_b = [], []
        for g in busy.tolist():
            key = tuple(int(c[starts[g]]) for c in cols[:3])
            own = fp[starts[g]:starts[g] + homes[g]]
            others = fp[starts[g] + homes[g]:ends[g]]
            before = residents if g == 0 and key == open_key else residents[:0]
            for r, v, same in ((before, own, False), (own, own, True), (np.concatenate([before, own]), others, False)):
                if len(r) and len(v):
                    a, b = _linked(r, v, same, threshold)
                    out_a.append(a)
                    out_b.append(b)
            if ends[g] == len(fp):
                residents, open_key = np.concatenate([before, own]), key
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def near_links(distinct: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp`` at ``threshold`` (11 at most) or fewer bits, by anchors.

    The links join exactly the fingerprints that all links would join; within a group only a forest of them is given out, closest
    pairs first, so that dense groups of near copies stay linear. An anchor with over ``block``
    residents is split: residents and visitors are dealt into blocks by hash and every pair of blocks is a group of its
    own, so that no pair is lost and no task gets the whole.
    """
    homes = distinct.select("fp").mapInArrow(lambda batches: _replicas(batches, threshold, False), "anchor long, fp long")
    visits = distinct.select("fp").mapInArrow(lambda batches: _replicas(batches, threshold, True), "anchor long, fp long")
    counts = homes.groupBy("anchor").agg(F.count("*").alias("n"))
    crowded = materialize(counts.where(F.col("n") > block).select("anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "crowded")
    homes, visits = (x.join(crowded, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) for x in (homes, visits))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    role = lambda n: F.lit(n).cast("byte").alias("visits")
    residents = homes.select("anchor", own.alias("rb"), every.alias("vb"), role(0), "fp")
    guests = homes.where("blocks > 1").select("anchor", every.alias("rb"), own.alias("vb"), role(1), "fp")
    visitors = visits.select("anchor", every.alias("rb"), own.alias("vb"), role(1), "fp")
    grouped = residents.unionByName(visitors).unionByName(guests).repartition("anchor", "rb", "vb").sortWithinPartitions("anchor", "rb", "vb", "visits")
    return grouped.mapInArrow(lambda batches: _compare(batches, threshold), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links between fingerprints.

    Texts are lower-cased (A-Z), cut into words at white space and into shingles of ``words``
    words, repeats included; a shorter text is one shingle, a text without words (or null) has
    fingerprint zero and is linked like any other. Rows with equal fingerprints are one class and compared once.

    A null doc_id belongs to its class but names no component unless the component has no other id.
    Repeated rows get equal values each; an empty table gives no rows. Other columns are ignored.
    """
    marked = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(near_links(classes, threshold), "a", "b")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = materialize(rooted.select("fp", "root").join(names, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(known, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
