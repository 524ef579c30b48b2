"""Fill-in-the-middle texts, cut by content-defined chunks whose summaries are remembered.

A rolling hash over ``SPAN`` bytes ends a chunk wherever its low bits are zero, so that equal passages fall into equal
chunks whatever stands around them. A chunk is looked up by its bytes (a hash finds it, its content confirms it); its summary holds
the number of code points, the bytes at its two ends and whether a marker lies inside. Summaries combine: counts add
up to the length of the text and to the chunk a cut lies in, and only that chunk is looked into; markers over a
boundary are found in the ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Bytes of the rolling hash, and of an average and of the longest chunk.
SPAN, AVERAGE, LONGEST = 32, 2048, 1 << 15
#: Bytes of chunks that are remembered; the memo starts anew beyond that.
_MEMO_BYTES = 48 << 20
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15


class Chunks:
    """Chunks of texts and the memo of their summaries."""

    def __init__(self) -> None:
        self.memo: dict[bytes, tuple[int, bool, bytes, bytes]] = {}
        self.held = 0
        power = np.full(SPAN, _BASE, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power, dtype=np.uint64)[::-1]

    def boundaries(self, text: bytes) -> list[int]:
        """Ends of the chunks of a text, its own end last."""
        ends: list[int] = []
        for lo in range(0, len(text), _PIECE):
            buf = np.frombuffer(text, np.uint8, min(_PIECE + SPAN - 1, len(text) - lo), lo)
            if len(buf) < SPAN:
                continue
            # By doubling: the hash of 2k bytes from two of k.
            h, size = buf.astype(np.uint64) + np.uint64(1), 1
            while size < SPAN:
                h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
                size *= 2
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            ends += (np.flatnonzero((h >> np.uint64(32)) % np.uint64(AVERAGE) == 0) + lo + SPAN).tolist()
        out, at = [], 0
        for end in [*ends, len(text)]:
            while end - at > LONGEST:
                at += LONGEST
                out.append(at)
            if end > at:
                out.append(end)
                at = end
        return out

    def summary(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        """Code points that begin in the chunk, whether a marker lies in it, its first and last two bytes."""
        found = self.memo.get(chunk)
        if found is None:
            if self.held > _MEMO_BYTES:
                self.memo.clear()
                self.held = 0
            raw = np.frombuffer(chunk, np.uint8)
            points = len(chunk) - int(np.count_nonzero((raw & 0xC0) == 0x80))
            found = self.memo[chunk] = (points, any(m in chunk for m in _MARKERS), chunk[:2], chunk[-2:])
            self.held += len(chunk) + 200
        return found


class Outline:
    """A text as chunks and their summaries combined."""

    def __init__(self, text: bytes, chunks: Chunks) -> None:
        self.text, self.ends = text, chunks.boundaries(text)
        self.before: list[int] = []  # code points before each chunk
        self.points, self.marked = 0, False
        at, tail = 0, b""
        for end in self.ends:
            points, marked, first, last = chunks.summary(text[at:end])
            self.before.append(self.points)
            self.points += points
            self.marked |= marked or any(m in tail + first for m in _MARKERS)
            tail = (tail + last)[-2:] if end - at < 2 else last
            at = end

    def offset(self, point: int) -> int:
        """Byte at which a code point begins; the end for the number of code points."""
        if point >= self.points:
            return len(self.text)
        lo, hi = 0, len(self.before)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.before[mid] <= point else (lo, mid)
        at, end = self.ends[lo - 1] if lo else 0, self.ends[lo]
        inside = point - self.before[lo]
        raw = np.frombuffer(self.text, np.uint8, end - at, at)
        return at + int(np.flatnonzero((raw & 0xC0) != 0x80)[inside])


def _transformed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    chunks = Chunks()
    for batch in batches:
        rows: list[tuple] = []
        first, size = 0, 0
        for i in range(batch.num_rows):
            cell = batch.column(1)[i]
            text = cell.as_buffer().to_pybytes() if cell.is_valid else b""
            one, two, three, four = (batch.column(2 + k)[i].as_py() for k in range(4))
            outline = Outline(text, chunks)
            if not text or outline.marked or three % 100 >= 90:
                rows.append((outline.points, "plain", None, None, text))
            else:
                low, high = sorted((one % (outline.points + 1), two % (outline.points + 1)))
                a, b = outline.offset(low), outline.offset(high)
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                spm = four % 100 < 20
                parts = (b"<S>", suffix, b"<P>", prefix) if spm else (b"<P>", prefix, b"<S>", suffix)
                rows.append((outline.points, "spm" if spm else "psm", low, high - low, b"".join((*parts, b"<M>", middle))))
            size += len(text)
            if size >= _PIECE * 4 or i + 1 == batch.num_rows:
                cells = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:5])]
                output = pa.array([r[4] for r in rows], pa.binary()).cast(schema.field(5).type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)).cast(schema.field(0).type), *cells[:4], output], schema=schema)
                rows, first, size = [], i + 1, 0


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.

    A text of n code points is cut at two places that a hash of the doc_id names; ``form`` says how its parts are set: psm is
    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, plain the text as it is (the
    two counts are null then). Empty texts, texts with a marker of their own and a tenth of the others stay plain.

    A null text is empty; a null doc_id is hashed like an empty one. Repeated rows are cut alike; an empty table gives no
    rows; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(seed, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ])
    schema = to_arrow_schema(kind)
    slim = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), *draws)
    return slim.mapInArrow(lambda batches: _transformed(batches, schema), kind)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; its parts hold no marker, so each marker occurs once."""
    def between(begin: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, begin, -1), end, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


INFILL_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS seed FROM documents),
draws AS (SELECT *, CAST('0x' || seed[1:8] AS BIGINT) AS h1, CAST('0x' || seed[9:16] AS BIGINT) AS h2, CAST('0x' || seed[17:24] AS BIGINT) AS h3, CAST('0x' || seed[25:32] AS BIGINT) AS h4 FROM docs),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cuts),
made AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts),
read AS (SELECT *, string_split(replace(replace(replace(output, '<P>', chr(0)), '<S>', chr(0)), '<M>', chr(0)), chr(0)) AS found FROM made)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN found[2] || found[4] || found[3] ELSE found[3] || found[4] || found[2] END) AS restored_sha256
FROM read
"""
