from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text[, lang[, source]]) rows, with further columns whose names the operators use inside."""
    def make(rows):
        full = [(r[0], r[1], *(r[2:3] or ("en",)), *(r[3:4] or ("a",)), len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        clashing = {c: "doc_id" for c in ("block", "blocks", "name", "key", "size", "copies", "fp", "_block", "_null", "_number", "anchor", "score")}
        return frame.selectExpr("*", *[f"{v} AS {c}" for c, v in clashing.items()])

    return make
