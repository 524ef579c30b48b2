"""Document fingerprints by I-Match over randomised lexicon subsets, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from braidset.session import materialize

#: Of 4096 hash values of a term, how many put it into a subset; each rate is used by SUBSETS_EACH subsets.
RATES = (256, 64, 16, 4)
SUBSETS_EACH = 8
SUBSETS = len(RATES) * SUBSETS_EACH
#: Terms in more than one document of LEAST and in at most one of MOST documents (idf between ln 10 and ln 1000).
MOST_COMMON, LEAST_COMMON = 10, 1000
#: A lexicon of more rows is joined by shuffle; see ``lexicon`` for its bound.
BROADCAST_ROWS = 500_000
_NOT_WORD = r"[^\p{L}\p{N}]+"
_EMPTY = "--------"


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), _NOT_WORD)), "")


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, subset): terms of the idf band in each of the subsets that they are in.

    A term of the band is in over one of LEAST_COMMON documents, so with d distinct terms a document on average the
    band has at most LEAST_COMMON * d terms, however many documents there are.
    """
    n = docs.count()
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counted.where((F.col("df") * MOST_COMMON <= n) & (F.col("df") * LEAST_COMMON >= n)).select("term")
    limits = F.array(*[F.lit(f"{RATES[k // SUBSETS_EACH]:03x}") for k in range(SUBSETS)])
    every = band.select("term", F.posexplode(limits).alias("subset", "_limit"))
    drawn = F.substring(F.md5(F.concat(F.col("subset").cast("string"), F.lit(":"), F.col("term")).cast("binary")), 1, 3)
    return materialize(every.where(drawn < F.col("_limit")).select("term", "subset"), "lexicon")


def fingerprint_of(hashes: Column, digest: Column) -> Column:
    """Fingerprint from the hashes of a text's subsets (array of subset, hash), or the text's own digest if all are empty."""
    by_subset = F.map_from_entries(hashes)
    parts = [F.coalesce(F.element_at(by_subset, F.lit(k)), F.lit(_EMPTY)) for k in range(SUBSETS)]
    return F.when(F.size(hashes) == 0, F.concat(F.lit("="), digest)).otherwise(F.concat(*parts))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes among the subsets that either text has terms in; 1 for equal fingerprints."""
    part = lambda c, k: F.substring(c, 8 * k + 1, 8)
    both = sum(((part(a, k) == part(b, k)) & (part(a, k) != _EMPTY)).cast("int") for k in range(SUBSETS))
    either = sum(((part(a, k) != _EMPTY) | (part(b, k) != _EMPTY)).cast("int") for k in range(SUBSETS))
    own = a.startswith("=") | b.startswith("=")
    return F.when(a == b, 1.0).when(own | a.isNull() | b.isNull(), 0.0).otherwise(both / F.greatest(either, F.lit(1)))


def in_order(docs: DataFrame, blocks: int) -> tuple[DataFrame, Window]:
    """Rows in blocks of neighbouring ids, each block followed by the first row of the next one (``_extra``).

    The borders of the blocks are approximate quantiles of the ids, ``blocks`` numbers as in any range partitioning, so
    the order is whole although no task sorts all rows. The last block is followed by the very first row.
    """
    marks = [i / blocks for i in range(1, blocks)]
    borders = docs.agg(F.percentile_approx("doc_id", marks, 10_000).alias("b")).first()["b"] or []
    borders = sorted(set(borders))
    width = max(1, int(len(borders) ** 0.5))
    runs = [borders[i:i + width] for i in range(0, len(borders), width)]
    block = F.lit(0)
    if runs:
        heads = F.expr("array(" + ",".join(f"{r[0]}L" for r in runs) + ")")
        nested = F.expr("array(" + ",".join("array(" + ",".join(f"{x}L" for x in r) + ")" for r in runs) + ")")
        run = F.size(F.filter(heads, lambda x: x <= F.col("doc_id")))
        inside = F.size(F.filter(F.element_at(nested, run), lambda x: x <= F.col("doc_id")))
        block = F.when(F.col("doc_id").isNull() | (run == 0), 0).otherwise((run - 1) * width + inside)
    placed = docs.withColumn("_block", block.cast("int"))
    firsts = placed.groupBy("_block").agg(F.min(F.struct("doc_id")).alias("_head"))
    # One row per block: a window over all of them is as small as the borders.
    ring = Window.orderBy("_block")
    everything = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(
        F.coalesce(F.lag("_block").over(ring), F.last("_block").over(everything)).alias("_before"), F.col("_head.doc_id").alias("_head_id"))
    heads = placed.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("_head_id"))).groupBy("_before").agg(
        F.min(F.struct("doc_id", "text")).alias("_row"))
    heads = heads.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), F.col("_before").alias("_block"), F.lit(1).alias("_extra"))
    return placed.withColumn("_extra", F.lit(0)).unionByName(heads), Window.partitionBy("_block").orderBy("_extra", "doc_id", "text")


def imatch_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its last
    half replaced by as many leading characters of the next text by ascending doc_id (after the last: the first). A fingerprint
    keeps the terms of an idf band, sorts and hashes those of each of 32 random subsets of the
    lexicon; the subsets have four densities, so that short and long texts both keep
    some subsets through an edit.

    A null text counts as empty; a text without a term of the lexicon is its own digest, so only equal texts
    are alike. Rows of one doc_id are ordered by text, null ids come first. A single row is its own next. An empty table
    gives no rows. Other columns are ignored.
    """
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = lexicon(slim)
    rows, window = in_order(slim, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    half = F.floor(F.length("text") / 2).cast("int")
    following = F.lead("text").over(window)
    edited = F.when(F.col("_extra") == 0, F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(following, F.lit(1), half)))
    rows = rows.withColumn("_place", F.row_number().over(window)).withColumn("_edited", edited)
    sides = rows.select(
        "_block", "_place", "_extra", "doc_id", F.length("text").cast("long").alias("n_chars"), F.posexplode(F.array("text", "_edited")).alias("_side", "_text")
    ).where(F.col("_text").isNotNull())
    found = sides.select(
        "_block", "_place", "_extra", "doc_id", "n_chars", "_side", F.unhex(F.sha2("_text", 256)).alias("_sha"),
        F.explode(F.concat(F.array(F.lit("")), terms(F.col("_text")))).alias("term"),
    )
    # The empty term stands for the text itself, so that texts without a term of the lexicon stay.
    blank = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).alias("subset"))
    known = words.unionByName(blank)
    known = F.broadcast(known) if words.count() <= BROADCAST_ROWS else known
    place = ["_block", "_place", "_side"]
    carried = ["_extra", "doc_id", "n_chars", "_sha"]
    hashed = found.join(known, "term").groupBy(*place, "subset").agg(
        F.substring(F.md5(F.array_join(F.sort_array(F.collect_list("term")), " ").cast("binary")), 1, 8).alias("_hash"),
        *[F.any_value(c).alias(c) for c in carried])
    own = F.when(F.col("subset") >= 0, F.struct("subset", "_hash"))
    hashed = hashed.groupBy(*place).agg(F.collect_list(own).alias("_hashes"), *[F.any_value(c).alias(c) for c in carried])
    hashed = hashed.withColumn("_sha", F.lower(F.hex("_sha"))).withColumn("_print", fingerprint_of(F.col("_hashes"), F.col("_sha")))
    of = lambda side, c: F.max(F.when(F.col("_side") == side, F.col(c)))
    texts = hashed.groupBy("_block", "_place", "_extra", "doc_id", "n_chars").agg(
        of(1, "_sha").alias("edited_sha256"), of(0, "_print").alias("fingerprint"), of(1, "_print").alias("edited_fingerprint"))
    texts = texts.withColumn("_next", F.lead("fingerprint").over(Window.partitionBy("_block").orderBy("_place"))).where("_extra = 0")
    return texts.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )


_RATE_SQL = "CASE " + " ".join(f"WHEN k < {(i + 1) * SUBSETS_EACH} THEN '{r:03x}'" for i, r in enumerate(RATES)) + " END"
IMATCH_SQL = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, text) AS n, count(*) OVER () AS total FROM base),
paired AS (SELECT a.n, a.doc_id, a.text, length(a.text) AS n_chars,
    left(a.text, CAST(length(a.text) - length(a.text) // 2 AS BIGINT)) || left(b.text, CAST(length(a.text) // 2 AS BIGINT)) AS edited,
    CASE WHEN a.n = a.total THEN 1 ELSE a.n + 1 END AS next FROM numbered a JOIN numbered b ON b.n = CASE WHEN a.n = a.total THEN 1 ELSE a.n + 1 END),
sides AS (SELECT n, 0 AS side, text FROM paired UNION ALL SELECT n, 1, edited FROM paired),
words AS (SELECT n, side, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'))) AS term FROM sides),
band AS (SELECT term FROM words WHERE side = 0 AND term <> '' GROUP BY term
  HAVING count(*) * {MOST_COMMON} <= (SELECT count(*) FROM base) AND count(*) * {LEAST_COMMON} >= (SELECT count(*) FROM base)),
members AS (SELECT term, k FROM band, range({SUBSETS}) t(k) WHERE substr(md5(k || ':' || term), 1, 3) < {_RATE_SQL}),
hashes AS (SELECT n, side, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h FROM words JOIN members USING (term) GROUP BY n, side, k),
prints AS (SELECT s.n, s.side, CASE WHEN count(h.k) = 0 THEN '=' || any_value(sha256(s.text))
    ELSE string_agg(coalesce(h.h, '{_EMPTY}'), '' ORDER BY t.k) END AS print
  FROM sides s CROSS JOIN range({SUBSETS}) t(k) LEFT JOIN hashes h ON h.n = s.n AND h.side = s.side AND h.k = t.k GROUP BY s.n, s.side),
trio AS (SELECT p.doc_id, p.n_chars, sha256(p.edited) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint, c.print AS next_print
  FROM paired p JOIN prints a ON a.n = p.n AND a.side = 0 JOIN prints b ON b.n = p.n AND b.side = 1 JOIN prints c ON c.n = p.next AND c.side = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {{near_edited}} AS near_edited, {{near_next}} AS near_next FROM trio
"""


def _like_sql(a: str, b: str) -> str:
    pa, pb = f"substr({a}, 8 * k + 1, 8)", f"substr({b}, 8 * k + 1, 8)"
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN starts_with({a}, '=') OR starts_with({b}, '=') THEN 0.0::DOUBLE ELSE "
        f"(SELECT CAST(count(*) FILTER (WHERE {pa} = {pb} AND {pa} <> '{_EMPTY}') AS DOUBLE) / "
        f"greatest(count(*) FILTER (WHERE {pa} <> '{_EMPTY}' OR {pb} <> '{_EMPTY}'), 1) FROM range({SUBSETS}) t(k)) END"
    )


IMATCH_SQL = IMATCH_SQL.replace("{near_edited}", _like_sql("fingerprint", "edited_fingerprint")).replace("{near_next}", _like_sql("fingerprint", "next_print"))
