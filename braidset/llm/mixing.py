"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from braidset.llm.common import running_sum
from braidset.operators.ordinals import global_ordinal
from braidset.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 1024


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of the sources of ``sized`` (source, size, merit): source, source_size, weighted, target.

    Sources in code point order, null last, take the weights in turn and share ``share``
    times all words by weight. A target stops at ``most`` times its source's size and the
    excess is shared again by weight until none is above. One row per source; the level is
    found by aggregates over that table, a scalar per round.
    """
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("merit")).alias("weighted")
    ).withColumn("_null", F.col("source").isNull())
    ranked = global_ordinal(sources, ["_null", "source"], "_rank")
    turns = F.array(*[F.lit(int(w)) for w in weights])
    ranked = materialize(
        ranked.withColumn("weight", F.element_at(turns, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most))),
        "sources",
    )
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    while level != before:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        left = ranked.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open")
        ).first()
        before, level = level, (total - left["full"]) / left["open"] if left["open"] else level
    plain = F.col("weight") * F.lit(level)
    return ranked.select("source", "source_size", "weighted", F.least(plain, F.col("cap")).alias("target"))


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, half_merit: int = 512, seed: str = "mix"
) -> DataFrame:
    """How often each document enters the mix: doc_id, source, size, source_size, target, copies, taken.

    ``size`` counts words (null text: 0). A document's expected copies are its source's ratio
    target / source_size plus up to the room left on either side of it, by merit: the share
    size / (size + half_merit), centred on its word-weighted mean so that expected words meet
    the target exactly. Whole copies are certain. The fraction is the inclusion probability p
    of a Pareto sample: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u from a hash of
    seed and doc_id, and taken in that order while at least half of the next one fits what the
    certain copies leave of the target. So a source misses its target by half a document at
    most, and none exceeds ``most`` times its size (``most`` of 2 or less: two copies).

    Nulls: a null source is a source of its own, a null text has no words, a null doc_id
    draws like any other value. Documents without words take nothing. Rows that repeat a doc_id
    draw the same number; rows equal in doc_id and size are interchangeable. An empty table
    gives no rows. Other columns are ignored. No group is windowed as a whole.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    sized = docs.select("doc_id", "source", size.alias("size")).withColumn(
        "merit", F.floor(F.col("size") * _STEPS / (F.col("size") + half_merit)).cast("long")
    ).withColumn("u", (drawn.cast("long") + 0.5) / F.lit(float(2**52)))
    sized = materialize(sized, "sized")
    targets = source_targets(sized, weights, share, most)

    words = F.greatest(F.col("source_size"), F.lit(1))
    ratio = F.col("target") / words
    room = F.least(ratio, F.lit(float(most)) - ratio)
    copies = ratio + room * ((F.col("merit") - F.col("weighted") / words) / F.lit(float(_STEPS)))
    joined = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    joined = joined.withColumn("_copies", F.greatest(F.lit(0.0), F.least(F.lit(float(most)), copies)))
    joined = joined.withColumn("_sure", F.floor("_copies").cast("long")).withColumn("_p", F.col("_copies") - F.col("_sure"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("_p") / (1 - F.col("_p")))
    joined = joined.withColumn("_order", F.when(F.col("_p") > 0, odds)).withColumn("_null", F.col("source").isNull())
    joined = joined.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_draws", F.when(F.col("_p") > 0, F.col("size")).otherwise(0))

    fixed = running_sum(joined.drop("merit", "u", "weighted", "_copies"), ["_null", "_source"], ["_order", "doc_id", "size"], "_draws", "_upto")
    sure = joined.groupBy("_null", "_source").agg(F.sum(F.col("_sure") * F.col("size")).alias("_sure_words"))
    chosen = (F.col("_p") > 0) & (F.col("_upto") - F.col("size") / 2 <= F.col("target") - F.col("_sure_words"))
    return fixed.join(sure, ["_null", "_source"]).withColumn(
        "copies", F.col("_sure") + F.when(chosen, 1).otherwise(0)
    ).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(md5_number_upper_placeholder AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
merits AS (SELECT *, CAST(floor(size * 1024 / (size + 512)) AS BIGINT) AS merit FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * merit)::BIGINT AS weighted FROM merits GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    source_size * 2.0::DOUBLE AS cap FROM totals),
filled AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) /
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM filled WHERE weight * level <= cap ORDER BY cap / weight LIMIT 1),
targets AS (SELECT source, source_size, weighted, least(CAST(weight AS DOUBLE) * level, cap) AS target FROM ranked, chosen),
ratios AS (SELECT m.*, t.source_size, t.target, t.weighted, t.target / greatest(t.source_size, 1) AS ratio
  FROM merits m JOIN targets t ON m.source IS NOT DISTINCT FROM t.source),
expected AS (SELECT *, greatest(0.0::DOUBLE, least(2.0::DOUBLE,
    ratio + least(ratio, 2.0::DOUBLE - ratio) * ((merit - weighted / greatest(source_size, 1)::DOUBLE) / 1024.0::DOUBLE))) AS copies FROM ratios),
split AS (SELECT *, CAST(floor(copies) AS BIGINT) AS sure, copies - floor(copies) AS p FROM expected),
drawn AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS ord FROM split),
summed AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER
    (PARTITION BY source ORDER BY ord NULLS FIRST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  sum(sure * size) OVER (PARTITION BY source) AS sure_words FROM drawn)
SELECT doc_id, size, source_size, target,
  CAST((sure + CASE WHEN p > 0 AND upto - size / 2 <= target - sure_words THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM summed
""".replace("md5_number_upper_placeholder", "('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))")
