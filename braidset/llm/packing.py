"""Token pieces and their packing into fixed windows by best-fit decreasing."""

from __future__ import annotations

import os
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from braidset.llm.common import keep_between_tasks, tidied
from braidset.operators.ordinals import global_ordinal
from braidset.session import materialize

WINDOW = 1024
END_ID = 0
#: Words that are kept with their ids; beyond that the most used half of as many stays.
_MEMO_LIMIT = 400_000
_BLOCK = 4096
#: New words that are encoded as one text.
_JOINED = 200
_SLICE_BYTES = 4 << 20


class _Words(dict):
    """Number of each distinct word; a word not seen before gets the next number and waits to be encoded."""

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.waiting.append(word)
        return number


class Encoder:
    """Ids of whole texts; every distinct word is encoded once and looked up afterwards.

    The vocabulary's pre-tokens never reach over a single space between two other characters, and take
    that space at their front, so the ids of a text are those of its first word and of each further word with its
    space. Where a word begins or ends in white space, or is empty, the text is encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens that the library finds in a text before it cuts words.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how this vocabulary writes a space
        self._clear()

    def _shrink(self) -> None:
        """Keep the most used words; the others are encoded again when they come back."""
        words, hits, (ids, at, odd) = list(self.words), self.hits, self.tables[id(self.words)]
        kept = np.sort(np.argsort(-hits, kind="stable")[:_MEMO_LIMIT // 2])
        self._clear()
        sizes = np.diff(at)[kept]
        take = np.repeat(at[kept] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.words.update((words[i], n) for n, i in enumerate(kept.tolist()))
        self.tables[id(self.words)] = [ids[take], np.concatenate([[0], np.cumsum(sizes)]), odd[kept]]
        self.hits = hits[kept]

    def _clear(self) -> None:
        self.hits = np.zeros(0, np.int64)
        self.words = _Words()
        self.firsts = _Words()
        self.tables = {id(t): [np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)] for t in (self.words, self.firsts)}

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), _BLOCK):  # the library's results are far larger than their ids
            yield from [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:at + _BLOCK], add_special_tokens=False)]

    def _encode_words(self, words: list[str], space: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, each with ``space`` at its front, and the number of each word's ids.

        Many words are encoded as one text and told apart by the ids that begin with a space.
        """
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), _JOINED):
            part = words[at:at + _JOINED]
            if space:
                found = np.array(next(self._encode([" " + " ".join(part)])), np.uint32)
                cuts = np.flatnonzero(self.spaced[found])
                if len(cuts) == len(part) and cuts[0] == 0:
                    ids.append(found)
                    sizes.append(np.diff(cuts, append=len(found)))
                    continue
            each = list(self._encode([space + w for w in part]))
            ids.append(np.fromiter(chain.from_iterable(each), np.uint32))
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _odd(self, words: list[str]) -> np.ndarray:
        """Which words are empty, begin or end in white space, or hold an added token."""
        odd = np.fromiter((not w or w != w.strip() for w in words), bool, len(words))
        together = "".join(words)  # an added token of one word is in here too
        for token in self.added:
            if token in together:
                odd |= np.fromiter((token in w for w in words), bool, len(words))
        return odd

    def _settle(self, words: _Words, space: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = self.tables[id(words)]
        if words.waiting:
            odd = self._odd(words.waiting)
            ids, plain = self._encode_words([w for w, o in zip(words.waiting, odd.tolist()) if not o], space)
            sizes = np.zeros(len(odd), np.int64)
            sizes[~odd] = plain
            table[0] = np.concatenate([table[0], ids])
            table[1] = np.concatenate([table[1], table[1][-1] + np.cumsum(sizes)])
            table[2] = np.concatenate([table[2], odd])
            words.waiting = []
        return tuple(table)

    def encode(self, texts: Sequence[str] | pa.Array) -> list[np.ndarray]:
        if len(self.words) > _MEMO_LIMIT or len(self.firsts) > _MEMO_LIMIT:
            self._shrink()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = pc.split_pattern(texts, " ")
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        told = parts.flatten().dictionary_encode()  # a word is looked up once, however often these texts have it
        which, own = told.indices.to_numpy(zero_copy_only=False), told.dictionary.to_pylist()
        first = np.fromiter((self.firsts[own[i]] for i in which[upto[:-1]].tolist()), np.int64, len(texts))
        which = np.delete(which, upto[:-1])
        upto = upto - np.arange(len(upto))  # first words are gone
        uses = np.bincount(which, minlength=len(own))
        used = np.flatnonzero(uses)
        number = np.zeros(len(own), np.int64)
        number[used] = np.fromiter(map(self.words.__getitem__, map(own.__getitem__, used.tolist())), np.int64, len(used))
        numbers = number[which]
        w_ids, w_at, w_odd = self._settle(self.words, " ")
        f_ids, f_at, f_odd = self._settle(self.firsts, "")
        self.hits = np.pad(self.hits, (0, len(self.words) - len(self.hits)))
        self.hits[number[used]] += uses[used]
        sizes = w_at[numbers + 1] - w_at[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = w_ids[np.repeat(w_at[numbers] - ends[:-1], sizes) + np.arange(ends[-1])]
        out = [np.concatenate([f_ids[lo:hi], ids[x:y]]) for lo, hi, x, y in zip(f_at[first], f_at[first + 1], ends[upto[:-1]], ends[upto[1:]])]
        whole = f_odd[first] & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        whole[np.searchsorted(upto, np.flatnonzero(w_odd[numbers]), side="right") - 1] = True
        whole = np.flatnonzero(whole).tolist()
        for i, found in zip(whole, self._encode(texts.take(pa.array(whole, pa.int64())).to_pylist())):
            out[i] = np.array(found, np.uint32)
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder per worker process, so that later tasks find the words of earlier ones."""
    return Encoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    keep_between_tasks(__name__, _encoder.cache_clear)
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        full = np.cumsum(size) // _SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            texts = pc.fill_null(batch.column(1).slice(lo, hi - lo), "")
            ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in encoder.encode(texts)]
            sizes = np.array([len(x) for x in ids], np.int64)
            per = -(-sizes // window)
            row = np.repeat(np.arange(hi - lo), per)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * window
            length = np.minimum(window, sizes[row] - start)
            flat = np.concatenate(ids)
            offsets = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            owner = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([owner.cast(schema.field(0).type), pa.array(start), pa.array(length), pa.array(sizes[row]), packed], schema=schema)


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids: every text's ids and an end id, cut into full windows and a rest.

    ``ids`` holds unsigned 32-bit little-endian ids. A null or empty text is the end id alone. Rows that repeat are
    cut each for itself; other columns are ignored. ``path`` must be readable on the executors.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    schema = to_arrow_schema(kind)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidied(lambda batches: _pieces(batches, path, window, end_id, schema)), kind)


class CapacityTree:
    """Segment tree over remaining capacities 1..n: how many open windows have each."""

    def __init__(self, n: int) -> None:
        self.leaves = 1 << n.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, windows: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += windows
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """Smallest capacity of at least ``size`` with an open window."""
        at = self.leaves + size
        if self.count[at]:
            return size
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Where best-fit decreasing puts the pieces of each size, from their number alone.

    Pieces of one size are alike and so are windows of one history, so the steps are taken for whole
    ranges of windows at once. A range of windows with capacity c takes c // size pieces each,
    one window after the other, just as piece by piece: the window in use is always the tightest.
    Returns (size, first piece, last piece, pieces per window, first window, offset), pieces of a size
    counted from 0, windows from 0; at most a few rows per size.
    """
    tree, ranges, steps = CapacityTree(window), defaultdict(deque), []
    opened = 0
    for size in sorted(counts, reverse=True):
        done, left = 0, counts[size]
        while left:
            capacity = tree.tightest(size)
            if capacity is None:
                capacity = window
                need = -(-left // (window // size))
                ranges[capacity].append((opened, need))
                tree.add(capacity, need)
                opened += need
            first, number = ranges[capacity].popleft()
            tree.add(capacity, -number)
            each = capacity // size
            full, over = min(number, left // each), 0
            if full < number and left % each and left // each == full:
                over = left % each
            rest = first + full + (1 if over else 0)
            for at, windows, pieces in ((first, full, each), (first + full, 1, over)):
                if windows and pieces:
                    steps.append((size, done, done + windows * pieces - 1, pieces, at, window - capacity))
                    done += windows * pieces
                    left -= windows * pieces
                    if remaining := capacity - pieces * size:
                        ranges[remaining].append((at, windows))
                        tree.add(remaining, windows)
            if rest < first + number:
                ranges[capacity].appendleft((rest, first + number - rest))
                tree.add(capacity, first + number - rest)
    return steps


def pack(pieces: DataFrame, order: Sequence[str], window: int = WINDOW) -> DataFrame:
    """``pieces`` with sequence_id and offset: best-fit decreasing over all pieces by ``length`` (1 to ``window``).

    The pieces are numbered by length and ``order`` over range partitions. Only the number of
    pieces of each length, ``window`` rows at most, goes to the driver, which plans the windows; the
    plan (a few rows for each length) is broadcast and every piece finds its place by its number. The offsets in a
    sequence have no gaps. Pieces that tie in ``order`` are interchangeable. An empty table gives no rows.
    """
    kept = list(pieces.columns)
    numbered = global_ordinal(pieces, ["length", *order], "_number")
    counts = {int(r["length"]): r["count"] for r in numbered.groupBy("length").count().collect()}
    if any(not 0 < size <= window for size in counts):
        raise ValueError("pieces must have 1 to window ids")
    before, total = {}, 1
    for size in sorted(counts):
        before[size] = total
        total += counts[size]
    rows = [(s, before[s] + lo, before[s] + hi, each, first, offset) for s, lo, hi, each, first, offset in best_fit_decreasing(counts, window)]
    plan = pieces.sparkSession.createDataFrame(rows, "_size long, _lo long, _hi long, _each long, _first long, _base long")
    here = (F.col("length") == F.col("_size")) & F.col("_number").between(F.col("_lo"), F.col("_hi"))
    index = F.col("_number") - F.col("_lo")
    return numbered.join(F.broadcast(plan), here).select(
        *kept,
        (F.col("_first") + F.floor(index / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_base") + F.pmod(index, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, n_tokens, ids: the windows themselves, padded to ``window`` unless their length is a power of two."""
    joined = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    ids = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    power = F.bit_count("n_tokens") == 1
    padded = F.expr(f"rpad(ids, {4 * window}, unhex('{pad_id.to_bytes(4, 'little').hex()}'))")
    return joined.select("sequence_id", "n_tokens", ids.alias("ids")).withColumn("ids", F.when(power, F.col("ids")).otherwise(padded))


def packed_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of ``docs``; see ``pack``."""
    pieces = token_pieces(docs, path, window, end_id).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(materialize(pieces, "pieces"), ["doc_id", "start", "ids_crc32"], window)
