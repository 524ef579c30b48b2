"""Removing repeated windows of words: Rabin-Karp hashes of every window, counted in Spark, merged into maximal intervals.

A window (``WINDOW`` = 20 consecutive words of one row) is repeated if its words also start in a row of smaller doc_id, or
earlier in the same row. Every word has a 64-bit hash; prefix sums of hashes times powers of a base give the rolling hash
of any run of words by one subtraction, so that all windows of all texts are hashed in a few passes of numpy.

Few windows repeat, so they are counted in two steps:

- a window is named by its least rolling hash of 8 words; equal windows have equal names, and neighbouring windows mostly share one.
  A stretch of windows of one name is a row (name, digest of its windows). Names are counted in Spark: one that is in
  a single document is done, and one with equal stretches everywhere belongs to its smallest document.
- only windows of the other names are rows of their own, and are counted by (name, window hash), 128 bits in all.

The rows that come after the first document of their name or window are joined to the texts and merged into intervals.
Repeats inside a row are found where the row is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from braidset.llm.common import tidied
from braidset.session import discard, materialize

WINDOW = 20
#: Words of the runs whose least hash names a window.
GRAM = 8
#: Bytes of text that are hashed at once.
PIECE = 1 << 21
_STEP = 1 << 18  # windows that are rolled at once
_COUNT_BITS = 20  # a stretch is (first window << 20 | windows)
_BYTES, _WORDS, _GRAMS, _SECOND = 0xA0761D6478BD642F, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xE7037ED1A0B428DB


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2^64."""
    pair = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        pair.append(np.cumprod(steps, dtype=np.uint64))
    return pair[0], pair[1]


def rolling(hashes: np.ndarray, base: int, size: int) -> np.ndarray:
    """Hash of every run of ``size`` entries of ``hashes``, in order."""
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    power, inverse = _powers(base, _STEP + WINDOW)
    for lo in range(0, len(out), _STEP):
        part = hashes[lo:lo + _STEP + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[:len(part)], out=sums[1:])
        out[lo:lo + _STEP] = (sums[size:] - sums[:-size]) * inverse[:len(part) - size + 1]
    return _mixed(out)


class Words:
    """Words of texts laid end to end: place in ``buf``, text, and hash of each."""

    def __init__(self, texts: list[bytes]) -> None:
        self.buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        blank = (self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        self.start, self.end = edges[::2], edges[1::2]
        self.text = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        #: Number of the first word of every text, and of all words.
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.hash = np.zeros(len(self.start), np.uint64)
        power, inverse = _powers(_BYTES, PIECE + 1)
        lo = 0
        while lo < len(self.start):
            at = self.start[lo]
            hi = int(np.searchsorted(self.end, at + PIECE, side="right"))
            if hi == lo:  # one word longer than a piece
                self.hash[lo] = xxhash.xxh64_intdigest(self.buf[at:self.end[lo]].tobytes())
                lo += 1
                continue
            s, e = self.start[lo:hi] - at, self.end[lo:hi] - at
            sums = np.zeros(e[-1] + 1, np.uint64)
            np.cumsum((self.buf[at:at + e[-1]] + np.uint64(1)) * power[:e[-1]], out=sums[1:])
            self.hash[lo:hi] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
            lo = hi
        self.hash = _mixed(self.hash)

    def windows(self) -> np.ndarray:
        """Numbers of the words at which a window starts."""
        return np.flatnonzero(self.text[:max(0, len(self.text) - WINDOW + 1)] == self.text[WINDOW - 1:])

    def names(self) -> np.ndarray:
        """Least hash of the runs of ``GRAM`` words in the window at each word."""
        least, size, over = rolling(self.hash, _GRAMS, GRAM), 1, WINDOW - GRAM + 1
        if len(least) < over:
            return least[:0]
        while 2 * size <= over:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        return np.minimum(least[:len(least) - (over - size)], least[over - size:])


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    at = 0
    while at < batch.num_rows:
        first, size, texts = at, 0, []
        while at < batch.num_rows and size < PIECE:
            cell = batch.column(column)[at]
            texts.append(cell.as_buffer().to_pybytes() if cell.is_valid else b"")
            size += len(texts[-1])
            at += 1
        yield first, at, texts


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, text) to (name, digest, doc_id, mark, place): runs of windows of one name."""
    for batch in batches:
        for lo, hi, texts in _slices(batch, 2):
            words = Words(texts)
            at = words.windows()
            if not len(at):
                continue
            name, text = words.names()[at], words.text[at]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(name) != 0) | (np.diff(text) != 0)]))
            length = np.diff(np.append(head, len(at)))
            parts = -(-length // ((1 << _COUNT_BITS) - 1))
            if parts.max() > 1:
                step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * ((1 << _COUNT_BITS) - 1)
                head = np.repeat(head, parts) + step
                length = np.diff(np.append(head, len(at)))
            digest = np.add.reduceat(_mixed(rolling(words.hash, _WORDS, WINDOW)[at]), head)
            place = (at[head] - words.first[text[head]]) << _COUNT_BITS | length
            take = pa.array(text[head])
            yield pa.RecordBatch.from_arrays([
                pa.array(name[head].view(np.int64)), pa.array(digest.view(np.int64)), batch.column(0).slice(lo, hi - lo).take(take),
                batch.column(1).slice(lo, hi - lo).take(take), pa.array(place)], ["name", "digest", "doc_id", "mark", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, text, places) to (name, hash, doc_id, mark, place): single windows of the listed stretches."""
    for batch in batches:
        for lo, hi, texts in _slices(batch, 2):
            words = Words(texts)
            lists = batch.column(3).slice(lo, hi - lo)
            places = lists.flatten().to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy()))
            first, count = places >> _COUNT_BITS, places & ((1 << _COUNT_BITS) - 1)
            text, begin = np.repeat(text, count), np.repeat(first, count)
            own = begin + np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)
            at = own + words.first[text]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([
                pa.array(words.names()[at].view(np.int64)), pa.array(rolling(words.hash, _WORDS, WINDOW)[at].view(np.int64)),
                batch.column(0).slice(lo, hi - lo).take(take), batch.column(1).slice(lo, hi - lo).take(take), pa.array(own << _COUNT_BITS | 1)],
                ["name", "hash", "doc_id", "mark", "place"])


def _own_repeats(words: Words) -> np.ndarray:
    """Numbers of the words at which a window starts that its text had before."""
    at = words.windows()
    if not len(at):
        return at
    key = _mixed(rolling(words.hash, _WORDS, WINDOW)[at] + words.text[at].astype(np.uint64) * np.uint64(_BYTES))
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return at[:0]
    at = at[np.isin(key, again)]
    second, text = rolling(words.hash, _SECOND, WINDOW)[at], words.text[at]
    key = rolling(words.hash, _WORDS, WINDOW)[at]
    order = np.lexsort((at, second, key, text))
    same = (np.diff(text[order]) == 0) & (np.diff(key[order]) == 0) & (np.diff(second[order]) == 0)
    return at[order[1:][same]]


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, places) to (doc_id, n_words, spans, kept)."""
    for batch in batches:
        for lo, hi, texts in _slices(batch, 1):
            words = Words(texts)
            lists = batch.column(2).slice(lo, hi - lo)
            sizes = np.fromiter((len(x) if x.is_valid else 0 for x in lists), np.int64, hi - lo)
            places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            begin = (places >> _COUNT_BITS) + words.first[np.repeat(np.arange(hi - lo), sizes)]
            stop = begin + (places & ((1 << _COUNT_BITS) - 1)) + WINDOW - 1
            own = _own_repeats(words)
            over = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(over, np.concatenate([begin, own]), 1)
            np.add.at(over, np.concatenate([stop, own + WINDOW]), -1)
            gone = np.cumsum(over)[:-1] > 0
            # Maximal runs of removed words; a run ends with its text.
            new = np.ones(len(gone), bool)
            new[1:] = (np.diff(gone) != 0) | (np.diff(words.text) != 0)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(gone))
            runs = gone[head] if len(head) else np.zeros(0, bool)
            head, tail = head[runs], tail[runs]
            base = words.first[words.text[head]]
            per = np.searchsorted(words.text[head], np.arange(hi - lo + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(head - base), pa.array(tail - base)], ["start", "end"])
            # Kept words, each with the separator behind it as a space; the last word of a text goes without.
            kept = np.flatnonzero(~gone)
            last = np.ones(len(kept), bool)
            last[:-1] = np.diff(words.text[kept]) != 0
            size = words.end[kept] - words.start[kept] + ~last
            edge = np.zeros(len(words.buf) + 1, np.int8)
            np.add.at(edge, words.start[kept], 1)
            np.add.at(edge, words.start[kept] + size, -1)
            chars = words.buf.copy()
            chars[words.end] = 32
            chars = chars[np.cumsum(edge, dtype=np.int8)[:-1] > 0]
            ends = np.concatenate([[0], np.cumsum(size)])
            cuts = ends[np.searchsorted(words.text[kept], np.arange(hi - lo + 1))].astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, hi - lo).cast(schema.field(0).type), pa.array(np.diff(words.first)),
                pa.ListArray.from_arrays(pa.array(per), spans).cast(schema.field(2).type),
                pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cuts), pa.py_buffer(chars)]).cast(pa.binary())], schema=schema)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, spans, kept of every row: removed intervals of words (start, end), and the kept words joined by one space.

    Words are runs of bytes other than space and 09 to 0D, unchanged. A word goes if a window of 20 words over it also starts in a
    row of smaller doc_id, or earlier in its own row; all windows are judged on the input. ``kept`` is UTF-8 as given.

    A null text has no words; texts under 20 words lose nothing. Rows of one doc_id don't count against each other, repeated
    rows are cut alike. Rows with a null doc_id have no place in the order: they lose their own repeats only and count against no
    other. An empty table gives no rows; other columns are ignored. doc_id must be an integer type.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    placed = slim.where("doc_id IS NOT NULL")
    stretches = materialize(placed.mapInArrow(tidied(_stretches), "name long, digest long, doc_id long, mark long, place long"), "word-stretches")
    names = stretches.groupBy("name").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("digest").alias("least"), F.max("digest").alias("most"))
    # Tables of their own, so that a hot name or window is split where it is joined.
    names = materialize(names.where("lo < hi").select("name", "lo", (F.col("least") == F.col("most")).alias("alike")), "shared-names")
    shared = materialize(stretches.join(names, "name").where("NOT alike OR doc_id > lo").select("doc_id", "mark", "place", "alike"), "shared-stretches")
    discard(stretches, names)

    lists = shared.where("NOT alike").groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places"))
    listed = placed.join(lists, ["doc_id", "mark"]).select("doc_id", "mark", "text", "places")
    windows = materialize(listed.mapInArrow(tidied(_windows), "name long, hash long, doc_id long, mark long, place long"), "windows")
    firsts = materialize(windows.groupBy("name", "hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "first-windows")
    late = windows.join(firsts, ["name", "hash"]).where("doc_id > lo").select("doc_id", "mark", "place")
    late = late.unionByName(shared.where("alike").select("doc_id", "mark", "place"))
    found = materialize(late.groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places")), "late-windows")
    discard(shared, windows, firsts)

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    schema = to_arrow_schema(kind)
    return slim.join(found, ["doc_id", "mark"], "left").select("doc_id", "text", "places").mapInArrow(tidied(lambda batches: _cut(batches, schema)), kind)


#: Windows as strings of their words, on whole tables; ids of rows are unique there.
WINDOW_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM docs WHERE len(words) >= 20),
windows AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS w FROM places),
late AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1),
gone AS (SELECT doc_id, unnest(range(pos, pos + 20)) AS word FROM late),
lists AS (SELECT doc_id, list_distinct(list(word)) AS words FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(d.words) AS n_words, coalesce(len(l.words), 0) AS n_removed,
    CASE WHEN l.words IS NULL THEN d.words
      ELSE list_transform(list_filter(list_zip(d.words, range(1, len(d.words) + 1)), lambda p: NOT list_contains(l.words, p[2])), lambda p: p[1]) END AS words
  FROM docs d LEFT JOIN lists l ON l.doc_id = d.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(words, ' '), '')) AS kept_sha256 FROM kept
"""
