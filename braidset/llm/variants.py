"""Spelling variants: frequent words that differ by one edit, grouped under their most used form.

Letters are hashed to a few symbols. Words within one edit have reduced words within one edit (or equal ones), so the
one-edit neighbourhoods of all reduced words, joined with the reduced vocabulary, hold every pair; only words of joined
reduced words are compared, on their own letters. Neighbourhoods are symmetric: a replaced symbol is generated from the end with the
smaller symbol, and a pair of unequal lengths from its longer end, whose deletions are the other end's insertions.

Where two reduced words have very many words between them, those are not compared pair by pair: they meet by equal
strings with one letter left out, of which a word has few.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from braidset.session import discard, materialize

#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Pairs of words of two reduced words above which they meet by strings with one letter left out.
CROWDED = 4096
_RUN = re.compile("[a-zA-ZÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_DROP = 199
_HELD = 200_000
_BASE = 0x9E3779B97F4A7C15


def _counted(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """(doc_id as text, text) to (word, n), with a code point deleted where the run's crc32 says so."""
    held: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return rows

    crc = zlib.crc32
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            if not text:
                continue
            start = crc((batch.column(0)[i].as_py() or "").encode() + b":")
            for run, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
                if len(run) < shortest:
                    continue
                h = crc(run.encode(), start)
                if h % _DROP == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
                    if len(run) < shortest:
                        continue
                held[run] += n
            if len(held) >= _HELD:
                yield flush()
    if held:
        yield flush()


def frequent_words(docs: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` code points and ``least`` occurrences in all texts."""
    slim = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = slim.mapInArrow(lambda batches: _counted(batches, shortest), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _symbols(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    reduced = ((codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)
    return reduced, sizes, np.cumsum(sizes) - sizes


def _powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _reduced(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    """(word, n) to (word, n, key); equal keys are equal reduced words but for chance, which the comparison of words undoes."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        if words:
            reduced, sizes, starts = _symbols(words, symbols)
            place = np.arange(len(reduced)) - np.repeat(starts, sizes)
            key = np.add.reduceat(reduced * _powers(int(sizes.max()))[place], starts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], ["word", "n", "key"])


def _neighbourhoods(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    """(key, word) to (key, near): the reduced word, its replacements by greater symbols, and its deletions."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 20_000):
            part = batch.slice(lo, 20_000)
            words, key = part.column(1).to_pylist(), part.column(0).to_numpy().view(np.uint64)
            reduced, sizes, starts = _symbols(words, symbols)
            power = _powers(int(sizes.max()) + 1)
            owner = np.repeat(np.arange(len(words)), sizes)
            place = np.arange(len(reduced)) - starts[owner]
            term = reduced * power[place]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
            ahead = sums[:-1] - sums[starts][owner]  # symbols before this one
            behind = key[owner] - ahead - term
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            rows, near = [np.arange(len(words)), owner], [key, ahead + behind * inverse]
            for symbol in range(2, symbols + 1):
                less = np.flatnonzero(reduced < symbol)
                rows.append(owner[less])
                near.append(key[owner[less]] + (np.uint64(symbol) - reduced[less]) * power[place[less]])
            rows, near = np.concatenate(rows), np.concatenate(near)
            yield pa.RecordBatch.from_arrays([pa.array(key[rows].view(np.int64)), pa.array(near.view(np.int64))], ["key", "near"])


def _left_out(word: Column) -> Column:
    """(place, rest) of a word for every letter left out, and (0, word) itself."""
    def one(i: Column) -> Column:
        return F.struct(i.alias("place"), F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))).alias("rest"))
    return F.concat(F.array(F.struct(F.lit(0).alias("place"), word.alias("rest"))), F.transform(F.sequence(F.lit(1), F.length(word)), one))


def near_words(words: DataFrame, symbols: int = SYMBOLS, crowded: int = CROWDED) -> DataFrame:
    """(a, b), each pair once: words of ``words`` (word, n; no word twice) that differ by exactly one edit."""
    reduced = materialize(words.select("word", "n").mapInArrow(lambda batches: _reduced(batches, symbols), "word string, n long, key long"), "reduced-words")
    classes = materialize(reduced.groupBy("key").agg(F.min("word").alias("word"), F.count("*").alias("size")), "reduced-classes")
    around = classes.select("key", "word").mapInArrow(lambda batches: _neighbourhoods(batches, symbols), "key long, near long")
    near = classes.select(F.col("key").alias("near"), F.col("size").alias("near_size"))
    met = around.join(near, "near").distinct().where("key <> near OR near_size > 1")
    met = materialize(met.join(classes.select("key", "size"), "key"), "near-classes")
    own = reduced.select("key", F.col("word").alias("a"))
    other = reduced.select(F.col("key").alias("near"), F.col("word").alias("b"))
    few = met.where(F.col("size") * F.col("near_size") <= crowded).select("key", "near").join(own, "key").join(other, "near")
    few = few.where(((F.col("key") != F.col("near")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
    many = met.where(F.col("size") * F.col("near_size") > crowded).select("key", "near")
    ends = many.select("key").unionByName(many.select(F.col("near").alias("key"))).distinct()
    parts = reduced.join(ends, "key", "left_semi").select("key", "word", F.explode(_left_out(F.col("word"))).alias("part")).select("key", "word", "part.*")
    left = parts.select("key", F.col("word").alias("a"), F.col("place").alias("pa"), "rest")
    right = parts.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("place").alias("pb"), "rest")
    # One letter replaced: the same place left out of both; one letter more: left out of the longer word alone.
    same = (F.col("pa") == F.col("pb")) & (F.col("pa") > 0) & (F.col("a") != F.col("b"))
    more = ((F.col("pa") == 0) & (F.col("pb") > 0)) | ((F.col("pb") == 0) & (F.col("pa") > 0))
    paired = left.join(right, "rest").where(same | more).join(many, ["key", "near"], "left_semi")
    paired = paired.where((F.col("key") != F.col("near")) | (F.col("a") < F.col("b"))).select("a", "b").distinct()
    pairs = materialize(few.unionByName(paired), "near-words")
    discard(reduced, classes, met)
    return pairs


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5, symbols: int = SYMBOLS, crowded: int = CROWDED) -> DataFrame:
    """word, n, n_near, form, form_n, root of every frequent word of all texts.

    Words are runs of Latin letters, A-Z lower-cased; one run in 199, told by a crc32 of doc_id and run, loses a code point. ``n`` counts
    occurrences. Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's ``form`` is
    its near word of largest n (on ties the first in code-point order) if that has ``ratio`` times its n, else null;
    ``root`` is the last word along forms, the word itself without one.

    A null or empty text has no words, a null doc_id counts as an empty one, repeated rows count each. Without a
    frequent word there are no rows. Other columns are ignored.
    """
    words = materialize(frequent_words(docs, shortest, least), "frequent-words")
    pairs = near_words(words, symbols, crowded)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")))
    told = known.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = (F.col("best").isNotNull()) & (-F.col("best.less") >= ratio * F.col("n"))
    table = words.join(told, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.word")).alias("form"),
        F.when(chosen, -F.col("best.less")).alias("form_n"))
    table = materialize(table, "word-forms")
    # Counts grow by ``ratio`` along forms, which bounds their number; a round doubles the steps that are taken.
    top = table.agg(F.max("n").alias("n")).first()["n"] or least
    steps = max(1, math.floor(math.log(max(1, top / least), ratio) + 1e-9))
    roots = table.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        roots = materialize(roots, "word-roots")
        onward = roots.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("last"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("last", "root").alias("root"))
    return table.join(roots, "word").select("word", "n", "n_near", "form", "form_n", "root")


#: crc32 by its table (made from the polynomial), and pairs by equal strings with one letter left out.
VARIANT_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS step, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(
    list_transform(range(1, 2 * strlen(concat(doc_id, ':', run)), 2), lambda k: CAST('0x' || hex(concat(doc_id, ':', run))[k:k + 1] AS BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM runs, crc WHERE length(run) >= 6),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
parts AS (SELECT word, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS place FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b FROM parts a JOIN parts b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT p.word, w.word FROM parts p JOIN words w ON p.rest = w.word
  UNION SELECT w.word, p.word FROM parts p JOIN words w ON p.rest = w.word),
told AS (SELECT p.a AS word, count(*) AS n_near, arg_min(p.b, (-w.n, p.b)) AS best, max(w.n) AS best_n FROM pairs p JOIN words w ON w.word = p.b GROUP BY p.a),
forms AS (SELECT w.word, w.n, coalesce(t.n_near, 0) AS n_near, CASE WHEN t.best_n >= 5 * w.n THEN t.best END AS form, CASE WHEN t.best_n >= 5 * w.n THEN t.best_n END AS form_n
  FROM words w LEFT JOIN told t ON t.word = w.word),
walk AS (SELECT word, word AS last, 0 AS step FROM forms UNION ALL SELECT k.word, f.form, k.step + 1 FROM walk k JOIN forms f ON f.word = k.last WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM forms f JOIN (SELECT word, arg_max(last, step) AS root FROM walk GROUP BY word) r ON r.word = f.word
"""
