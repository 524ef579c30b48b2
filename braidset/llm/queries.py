"""Registered queries of the text operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from braidset.llm import langid, quality
from braidset.llm.common import held_out, read_table
from braidset.llm.imatch import IMATCH_SQL, imatch_fingerprints
from braidset.llm.infill import INFILL_SQL, fill_in_middle, restored
from braidset.llm.mixing import MIX_SQL, mix_documents
from braidset.llm.nndescent import near_vectors
from braidset.llm.packing import packed_documents
from braidset.llm.runindex import repeated_passages
from braidset.llm.simhash import hex_digits, simhash_groups
from braidset.llm.tokencount import token_counts
from braidset.llm.urltrust import URL_SQL, judge_urls
from braidset.llm.variants import VARIANT_SQL, spelling_variants
from braidset.llm.windowcut import WINDOW_SQL, repeated_windows


def op1_runindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_passages(read_table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_fingerprints(read_table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.language_spans(docs, langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op10_urltrust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op11_windowcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_windows(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_runindex, op2_quality, op3_imatch, op4_langid, op5_tokencount, op6_packing, op7_mixing, op8_nndescent, op9_simhash, op10_urltrust,
    op11_windowcut, op12_infill, op13_variants)}
ORACLES: dict[str, str] = {
    "op3_imatch": IMATCH_SQL, "op7_mixing": MIX_SQL, "op10_urltrust": URL_SQL, "op11_windowcut": WINDOW_SQL, "op12_infill": INFILL_SQL, "op13_variants": VARIANT_SQL}
