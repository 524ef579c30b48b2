"""Language identification: script ranges, per-word scores, Viterbi over the words of a text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from braidset.llm.common import held_out, tidied

#: Documents of each language that the scores are learned from (expected number; drawn by a hash of doc_id).
SAMPLE = 1500
BUCKETS = 1 << 16
#: Cost of changing the language between two words, in the unit of the word scores.
PENALTY = 12.0
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")  # also takes numerals that are no letters, such as a half or Roman eight in one character
_LONGEST = 32  # letters of one scored word; longer runs (scripts without spaces) are scored in parts
_MEMO_LIMIT = 250_000
_BLOCK = 20_000
_ROWS = 2000  # rows of a batch that are filtered at once
_SLICE_WORDS = 800_000
_SLICE_BYTES = 4 << 20
_FILTER_MEMO = 200_000  # words with scores beside a filtered batch

#: First code points of script ranges, in order.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = [s for s, _ in SCRIPTS]
_NAMES = sorted({n for _, n in SCRIPTS})


@lru_cache(maxsize=4096)
def script_of(letter: str) -> int:
    return _NAMES.index(SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1])


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased, the longest ones in parts."""
    found = _WORD.findall(text.lower())
    if not "".join(found).isalpha():
        found = [part for w in found for part in ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else (w,))]
    if any(len(w) > _LONGEST for w in found):
        found = [w[i:i + _LONGEST] for w in found for i in range(0, len(w), _LONGEST)]
    return found


def gram_buckets(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets of ``words`` in a few arrays, with the first entry of each word in them.

    Features are the runs of one to four letters with the word's ends marked, and the word itself.
    Entries without a feature are ``BUCKETS``.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    mix = np.uint64(0x9E3779B97F4A7C15)
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        rolling[:len(codes) - n + 1] = (rolling[:len(codes) - n + 1] ^ codes[n - 1:]) * mix
        hashed = rolling ^ (rolling >> np.uint64(29))
        yield np.where(left >= n, (hashed * mix >> np.uint64(40)) % np.uint64(BUCKETS), BUCKETS).astype(np.int64), starts
    place = np.arange(len(codes)) - np.repeat(starts, sizes) + 1
    whole = np.add.reduceat(codes * mix ** place.astype(np.uint64), starts)
    yield ((whole ^ (whole >> np.uint64(31))) * mix >> np.uint64(40)).astype(np.int64) % BUCKETS, np.arange(len(words))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (BUCKETS, langs), log probabilities
    allowed: np.ndarray  # (scripts, langs), which languages a script leaves as candidates


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    counts, scripts = np.zeros(BUCKETS + 1, np.float64), np.zeros(len(_NAMES), np.int64)
    seen: Counter[str] = Counter()

    def add() -> None:
        words = list(seen)
        for lo in range(0, len(words), _BLOCK):
            part = words[lo:lo + _BLOCK]
            times = np.array([seen[w] for w in part], np.float64)
            for buckets, starts in gram_buckets(part):
                counts[:] += np.bincount(buckets, np.repeat(times, np.diff(np.append(starts, len(buckets)))), BUCKETS + 1)
            for w in part:
                scripts[script_of(w[0])] += len(w) * seen[w]
        seen.clear()

    for text in rows["text"]:
        seen.update(words_of(text))
        if len(seen) > _MEMO_LIMIT:
            add()
    add()
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [counts[:BUCKETS].astype(np.int64).tobytes()], "scripts": [scripts.tobytes()]})


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of documents that are not held out.

    About ``sample`` documents of each language are drawn by a hash of their id, so a language's counts are one
    small group each; only their sums go to the driver.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))
    rates = F.broadcast(sizes.select("lang", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")).alias("rate")))  # one row per language
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = usable.join(rates, "lang").where(draw < F.col("rate")).select("lang", "text")
    rows = drawn.groupBy("lang").applyInPandas(_count, "lang string, counts binary, scripts binary").collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    counts = np.stack([np.frombuffer(r["counts"], np.int64) for r in rows], axis=1).astype(np.float64) + 0.1
    scripts = np.stack([np.frombuffer(r["scripts"], np.int64) for r in rows], axis=1)
    allowed = scripts > 0.01 * np.maximum(1, scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True  # a script never seen leaves every language
    return Model([r["lang"] for r in rows], np.log(counts / counts.sum(axis=0)).astype(np.float32), allowed)


class _Scorer(dict):
    """Numbers of distinct words, with a row of scores for each."""

    def __init__(self, model: Model) -> None:
        self.model, self.waiting, self.table = model, [], np.zeros((0, len(model.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.waiting.append(word)
        return number

    def settle(self) -> None:
        """Scores are n-gram log probabilities, a quarter of their sum as letters count in four lengths, relative to the best."""
        if not self.waiting:
            return
        scores = np.concatenate([self.model.scores, np.zeros((1, len(self.model.langs)), np.float32)])
        new = []
        for lo in range(0, len(self.waiting), _BLOCK):
            part = self.waiting[lo:lo + _BLOCK]
            rows = sum(np.add.reduceat(scores[buckets], starts, axis=0) for buckets, starts in gram_buckets(part)) / 4
            allowed = self.model.allowed[[script_of(w[0]) for w in part]]
            rows = np.where(allowed, rows, rows.min(axis=1, keepdims=True) - 2 * PENALTY)
            new.append((rows - rows.max(axis=1, keepdims=True)).astype(np.float32))
        self.table = np.concatenate([self.table, *new])
        self.letters = np.concatenate([self.letters, np.fromiter(map(len, self.waiting), np.int64, len(self.waiting))])
        self.waiting = []


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every row of ``scores`` for sequences given by start and length, all sequences in step.

    At each word the best path either stays in its language or leaves the best one for ``penalty``; on ties it stays,
    and the first language wins.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    labels = np.zeros(len(scores), np.int64)
    if not len(lengths) or not lengths[0]:
        return labels
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    came = np.zeros(scores.shape, np.uint8 if scores.shape[1] < 256 else np.int32)
    value = scores[starts[:active[0]]].astype(np.float64)
    own = np.arange(scores.shape[1])
    last = np.zeros(active[0], np.int64)
    last[lengths[:active[0]] == 1] = value.argmax(axis=1)[lengths[:active[0]] == 1]
    for t in range(1, lengths[0]):
        value = value[:active[t]]
        at = starts[:active[t]] + t
        best = value.argmax(axis=1)
        leave = value[np.arange(len(best)), best][:, None] - penalty
        came[at] = np.where(leave > value, best[:, None], own)
        value = np.maximum(value, leave) + scores[at]
        done = active[t + 1] if t + 1 < lengths[0] else 0
        if done < active[t]:
            last[done:active[t]] = value[done:].argmax(axis=1)
    for t in range(lengths[0] - 1, -1, -1):
        at = starts[:active[t]] + t
        labels[at] = last[:active[t]]
        last[:active[t]] = came[at, last[:active[t]]] if t else last[:active[t]]
    return labels


def _label(batches: Iterator[pa.RecordBatch], model: Model, penalty: float, schema: pa.Schema, scorer: _Scorer | None = None) -> Iterator[pa.RecordBatch]:
    scorer = _Scorer(model) if scorer is None else scorer
    names = np.array([*model.langs, UNKNOWN], object)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            if len(scorer) > _MEMO_LIMIT:
                scorer = _Scorer(model)
            numbers, words, first = [], 0, at
            while at < batch.num_rows and words < _SLICE_WORDS // max(1, len(model.langs) // 8):
                found = words_of(batch.column(1)[at].as_py() or "") if model.langs else []
                numbers.append(np.array(list(map(scorer.__getitem__, found)), np.int32))
                words += len(found)
                at += 1
            scorer.settle()
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
            lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
            starts = np.cumsum(lengths) - lengths
            labels = viterbi(scorer.table[flat], starts, lengths, penalty)
            letters = scorer.letters[flat]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            totals = np.zeros((len(lengths), len(model.langs) + 1), np.int64)
            np.add.at(totals, (owner, labels), letters)
            best = np.where(lengths > 0, totals[:, :-1].argmax(axis=1) if model.langs else -1, len(model.langs))
            share = totals[np.arange(len(best)), best] / np.maximum(1, totals.sum(axis=1))
            head = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(labels) != 0)])) if len(flat) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([head, [len(flat)]])) if len(flat) else head
            run_letters = np.add.reduceat(letters, head) if len(flat) else head
            per_doc = np.concatenate([[0], np.cumsum(np.bincount(owner[head], minlength=len(lengths)))]).astype(np.int32)
            spans = pa.StructArray.from_arrays(
                [pa.array(names[labels[head]], pa.string()), pa.array(head - starts[owner[head]], pa.int64()), pa.array(size, pa.int64()), pa.array(run_letters, pa.int64())],
                ["lang", "first_word", "words", "letters"])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, at - first).cast(schema.field(0).type), pa.array(names[best], pa.string()), pa.array(share.astype(np.float64)),
                pa.ListArray.from_arrays(pa.array(per_doc), spans).cast(schema.field(3).type)], schema=schema)


def language_spans(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans of every row of ``docs``.

    The script of a word leaves some languages as candidates, n-gram scores weigh them, and the best path over all words of
    the text, with a penalty on changing the language, labels spans (lang, first_word, words, letters). ``lang_pred`` is the
    language with most letters and ``score`` its share of the letters; on ties the first by name.

    A null text, or one without a letter, is ``und`` with score 0 and no spans, and so is every text if nothing could be
    learned. Repeated rows are labelled alike; an empty table gives no rows; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    span = T.StructType([T.StructField("lang", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("first_word", "words", "letters")]])
    kind = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span)),
    ])
    schema = to_arrow_schema(kind)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidied(lambda batches: _label(batches, model, penalty, schema)), kind)


def _share_of_best(texts: pa.Array, model: Model, penalty: float, scorer: _Scorer) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, numbers of the best languages, their shares of the letters) slice by slice; the number of languages means none."""
    at = 0
    while at < len(texts):
        numbers, size, first = [], 0, at
        while at < len(texts) and size < _SLICE_BYTES:
            cell = texts[at]
            found = words_of(cell.as_py() or "") if model.langs else []
            numbers.append(np.array(list(map(scorer.__getitem__, found)), np.int32))
            size += len(cell.as_buffer()) if cell.is_valid else 0
            at += 1
        scorer.settle()
        flat = np.concatenate(numbers)
        lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
        labels = viterbi(scorer.table[flat], np.cumsum(lengths) - lengths, lengths, penalty)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        width = len(model.langs) + 1
        totals = np.bincount(owner * width + labels, scorer.letters[flat], len(lengths) * width).reshape(-1, width)
        best = np.where(lengths > 0, totals[:, :-1].argmax(axis=1) if model.langs else 0, len(model.langs))
        yield first, best, totals[np.arange(len(best)), best] / np.maximum(1, totals.sum(axis=1))


def known_language(docs: DataFrame, model: Model, least: float = 0.5, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs``, all columns, whose best language has at least the share ``least`` of the letters of ``text``.

    The labels are those of ``language_spans``; no spans are made, record batches are filtered as they are, and what is held
    besides a batch is bounded by bytes of text. A text without a letter goes, a null one too; repeated rows go or stay together.
    """
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                if len(scorer) > _FILTER_MEMO:
                    scorer = _Scorer(model)
                for first, best, share in _share_of_best(part.column(column), model, penalty, scorer):
                    yield part.slice(first, len(best)).filter(pa.array((best < len(model.langs)) & (share >= least)))

    return docs.mapInArrow(tidied(keep), docs.schema)
