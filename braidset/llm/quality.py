"""Quality scores from a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from braidset.llm.common import held_out

#: Labelled documents of each class that the network learns from (expected number; drawn by a hash of doc_id).
SAMPLE = 1200
EMBEDDING, STRIDE, FILTERS = 8, 8, 32
EPOCHS, BATCH, RATE = 14, 48, 0.01
THRESHOLD = 0.3
_PAD = 256
_SLICE_BYTES = 4 << 20


@dataclass
class Network:
    """Bytes are embedded; filters see chunks of two strides, every stride bytes, so neighbouring chunks overlap by half."""

    embedding: np.ndarray  # (257, EMBEDDING), the last row is padding and stays zero
    filters: np.ndarray  # (STRIDE * EMBEDDING, 2 * FILTERS): first and second half of a chunk
    bias: np.ndarray
    weights: np.ndarray
    offset: float


def _grid(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in rows of one stride, every text with a row of padding at its end; first row of each text, and which rows are last."""
    rows = np.array([-(-len(t) // STRIDE) + 1 for t in texts], np.int64)
    starts = np.cumsum(rows) - rows
    grid = np.full(int(rows.sum()) * STRIDE, _PAD, np.int16)
    for t, s in zip(texts, starts.tolist()):
        grid[s * STRIDE:s * STRIDE + len(t)] = np.frombuffer(t, np.uint8)
    last = np.zeros(len(grid) // STRIDE, bool)
    last[starts + rows - 1] = True
    return grid.reshape(-1, STRIDE), starts, last


def _activations(net: Network, grid: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Filter outputs of every chunk; a chunk is a row and the next one, or padding after a text's last row."""
    halves = net.embedding[grid].reshape(len(grid), -1) @ net.filters
    out = halves[:, :FILTERS].copy()
    out[:-1] += np.where(last[:-1, None], np.float32(0), halves[1:, FILTERS:])
    return out + net.bias


def score_texts(net: Network, texts: Sequence[bytes]) -> np.ndarray:
    """Probability of label 1: filters over all chunks, maximum over the whole text, one logistic output."""
    scores = np.zeros(len(texts))
    cut, size = [0], 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _SLICE_BYTES:
            cut.append(i + 1)
            size = 0
    for lo, hi in zip(cut, [*cut[1:], len(texts)]):
        if lo == hi:
            continue
        grid, starts, last = _grid(texts[lo:hi])
        step = 1 << 15  # blocks of rows overlap by one, so that every chunk is seen whole
        top = np.full((hi - lo, FILTERS), -np.inf, np.float32)
        for at in range(0, len(grid), step):
            act = _activations(net, grid[at:at + step + 1], last[at:at + step + 1])[:step]
            inside = np.searchsorted(starts, [at, at + len(act)])
            edges = np.unique(np.concatenate([[0], starts[inside[0]:inside[1]] - at]))
            owners = np.searchsorted(starts, edges + at, side="right") - 1
            peaks = np.maximum.reduceat(act, edges, axis=0)
            top[owners] = np.maximum(top[owners], peaks)
        logits = np.maximum(top, 0) @ net.weights + net.offset
        scores[lo:hi] = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
    return scores


def fit(texts: Sequence[bytes], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss; the gradient of a maximum goes to the chunk that gave it."""
    rng = np.random.default_rng(seed)
    width = STRIDE * EMBEDDING
    p = {
        "e": rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32), "f": (rng.normal(0, 1, (width, 2 * FILTERS)) / np.sqrt(width)).astype(np.float32),
        "b": np.zeros(FILTERS, np.float32), "w": rng.normal(0, 0.1, FILTERS).astype(np.float32), "o": np.zeros(1, np.float32),
    }
    p["e"][_PAD] = 0
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            grid, starts, last = _grid([texts[i] for i in pick])
            net = Network(p["e"], p["f"], p["b"], p["w"], float(p["o"][0]))
            act = _activations(net, grid, last)
            ends = np.append(starts[1:], len(grid))
            where = np.stack([act[s:e].argmax(axis=0) + s for s, e in zip(starts, ends)])  # (docs, filters)
            peak = np.maximum(act[where, np.arange(FILTERS)], 0)
            prob = 1 / (1 + np.exp(-np.clip(peak @ p["w"] + p["o"][0], -60, 60)))
            d = ((prob - labels[pick]) / len(pick)).astype(np.float32)
            g = {"w": peak.T @ d + 1e-4 * p["w"], "o": np.array([d.sum()], np.float32)}
            dz = d[:, None] * p["w"] * (peak > 0)
            g["b"] = dz.sum(axis=0)
            g["f"], g["e"] = np.zeros_like(p["f"]), np.zeros_like(p["e"])
            for half in (0, 1):
                seen = grid[np.minimum(where + half, len(grid) - 1)]  # (docs, filters, STRIDE)
                if half:
                    seen[last[where]] = _PAD
                inputs = p["e"][seen].reshape(*where.shape, width)
                cols = slice(half * FILTERS, (half + 1) * FILTERS)
                g["f"][:, cols] = np.einsum("dfw,df->wf", inputs, dz)
                back = (dz[:, :, None] * p["f"][:, cols].T[None]).reshape(-1, EMBEDDING)
                np.add.at(g["e"], seen.reshape(-1), back)
            g["e"][_PAD] = 0
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return Network(p["e"], p["f"], p["b"], p["w"], float(p["o"][0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Learn ``labels.quality`` from whole texts of documents that are not held out.

    About ``sample`` labelled documents of each class, drawn by a hash of doc_id, go to the driver: a bound that
    does not grow with the data. Both classes weigh the same in training; the output is then set to the share of label 1
    among all labels that may be learned from. With one class or none the score is that share (one half without any label).
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rate = F.when(F.col("quality") == 1, min(1.0, sample / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample / max(1, sizes.get(0, 0))))
    drawn = known.where(draw < rate)  # about two samples of rows, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").collect()
    rows = sorted((r["doc_id"], r["quality"], r["text"] or "") for r in rows)
    y = np.array([r[1] for r in rows], np.float32)
    odds = np.log(max(sizes.get(1, 0), 0.5) / max(sizes.get(0, 0), 0.5))
    if len(set(y.tolist())) < 2:
        flat = Network(np.zeros((257, EMBEDDING), np.float32), np.zeros((STRIDE * EMBEDDING, 2 * FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), float(odds))
        return flat
    net = fit([r[2].encode("utf-8", "surrogatepass") for r in rows], y)
    net.offset += float(odds - np.log(y.sum() / (len(y) - y.sum())))
    return net


def _score(batches: Iterator[pa.RecordBatch], net: Network, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(schema.field(0).type), pa.array(score_texts(net, texts))], schema=schema)


def quality_scores(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; scores look at the whole text and nothing else.

    A null text counts as empty; an empty text has the score of padding alone. Repeated rows are scored alike. An
    empty table gives no rows. Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(kind)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(lambda batches: _score(batches, net, schema), kind)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
