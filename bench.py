"""Wall time of the headline queries; prints one JSON line.

The first query also pays for the session's start; queries that share stages of the
analysis find those stages computed, as later steps of a real run do. ``analysis`` is the
time to compute all stages from the given tables, measured before everything else; ``stages`` tells how it is spread over
the tables. ``text`` has the text operators, which are not part of ``value``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from braidset import schema  # noqa: E402
from braidset.catalog.queries import QUERIES, analysis  # noqa: E402
from braidset.session import configure  # noqa: E402

HEADLINE = (
    "normalize_text", "ts_order", "fnv_guid",
    "merge_locations", "merge_locations_tangled", "merge_user_marks", "mark_conflicts", "merge_block_ranges", "merge_notes",
    "note_conflicts", "merge_media", "merge_bookmarks", "merge_input_fields", "merge_playlist_items", "merge_tag_map",
    "lineage_blockrange", "dropped_counts", "auto_summary", "warnings", "finalize_notes", "finalize_ranges", "cleanup_all",
    "health_report", "fk_violations", "constraint_violations", "unique_violations", "reconcile_counts", "roundtrip", "traceability",
    "content_digest", "fingerprint", "idempotent_remerge", "text_change", "predict_counts",
)
TEXT_HEADLINE = ("op2", "op4", "op5", "op6", "op7", "op9", "op10", "op11", "op12", "op13")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("braidset-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times: dict[str, float] = {}

    stages: dict[str, float] = {}
    begin = start = time.time()
    whole = analysis(spark, sf_dir)
    for table in schema.TABLES:
        run(whole.merged(table))
        stages[table], start = round(time.time() - start, 3), time.time()
    whole.conflicts.count()
    stages["conflicts"] = round(time.time() - start, 3)
    times["analysis"] = round(time.time() - begin, 3)

    for name in HEADLINE:
        start = time.time()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - start, 3)
    text: dict[str, float] = {}
    try:
        from braidset.llm.queries import QUERIES as TEXT
    except ImportError:
        TEXT = {}
    for name in [n for n in TEXT if n.split("_")[0] in TEXT_HEADLINE]:
        start = time.time()
        run(TEXT[name](spark, sf_dir))
        text[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "stages": stages, "text": text,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
