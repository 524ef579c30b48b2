"""Token counts under a unigram vocabulary, by dynamic programming shared in a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

_NODE_LIMIT = 1_500_000
_WORD_LIMIT = 300_000
_SPACE = "▁"


def load_vocabulary(path: str) -> dict[str, float]:
    """Scores of a SentencePiece vocabulary's ordinary pieces: log probabilities by Zipf's law on the piece's rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class CountTrie:
    """Forward scores of a unigram segmentation, kept at the nodes of a trie.

    The best score of a prefix depends on the prefix alone, so it is computed once, when its node is made, and shared
    by all pre-tokens that begin with it. A node keeps the score and the number of tokens of its best segmentation; ties go to
    fewer tokens. A character that no piece covers costs one token per UTF-8 byte.
    """

    def __init__(self, vocabulary: dict[str, float]) -> None:
        # Every end of a piece, with the score of those that are pieces themselves.
        self.endings: dict[str, float | None] = {p[i:]: None for p in vocabulary for i in range(len(p))}
        self.endings.update(vocabulary)
        self.unknown = min(vocabulary.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def count(self, pretoken: str) -> int:
        """Tokens of the pre-token, from its terminal node; new nodes are added for the part not seen before."""
        path, node, child, endings = [0], 0, self.child, self.endings
        for i, letter in enumerate(pretoken):
            key = node << 21 | ord(letter)
            following = child.get(key)
            if following is None:
                following = child[key] = len(self.score)
                size = len(letter.encode("utf-8", "surrogatepass"))
                best = (self.score[node] + size * self.unknown, -(self.tokens[node] + size))
                for j in range(i, -1, -1):
                    value = endings.get(pretoken[j:i + 1], 0.0)
                    if value == 0.0:  # no piece ends like this, nor can a longer one
                        break
                    if value is not None and (way := self.score[path[j]] + value) >= best[0]:
                        best = max(best, (way, -(self.tokens[path[j]] + 1)))
                self.score.append(best[0])
                self.tokens.append(-best[1])
            node = following
            path.append(node)
        return self.tokens[node]


class _Words(dict):
    def __init__(self, trie: CountTrie) -> None:
        self.trie = trie

    def __missing__(self, word: str) -> int:
        if len(self.trie.score) > _NODE_LIMIT:
            self.trie.clear()
        tokens = self.trie.count(_SPACE + word)
        if len(self) >= _WORD_LIMIT:
            self.clear()
        self[word] = tokens
        return tokens


@lru_cache(maxsize=1)
def _words(path: str) -> _Words:
    """One trie per worker process, so that later tasks find the words of earlier ones."""
    return _Words(CountTrie(load_vocabulary(path)))


def _count(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    words = _words(path)
    for batch in batches:
        numbers, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for i, text in enumerate(batch.column(1)):
            parts = (text.as_py() or "").split()
            numbers[i], tokens[i] = len(parts), sum(map(words.__getitem__, parts))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), pa.array(numbers), pa.array(tokens)], schema=schema)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text; pre-tokens are its words, each with a space mark before it.

    Each worker keeps one trie over the batches that it reads; a trie over one and a half million nodes is begun anew, which changes
    no count. No shuffle is needed. A null text, or one of white space only, has no tokens. Repeated rows are counted
    alike. An empty table gives no rows. Other columns are ignored. ``path`` must be readable on the executors.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    schema = to_arrow_schema(kind)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda batches: _count(batches, path, schema), kind)
