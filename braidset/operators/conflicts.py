"""Agreement of copies, newest copy, suggested winner of a conflict.

Copies have ``[*scope, src, pk]``, a group key and order keys made by ``ts_key``. A group
of copies is only ever aggregated, never collected, so one group may be arbitrarily big.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def agreement(signature: str | Column) -> Column:
    """Aggregate: do all copies carry the same (non-null) signature?"""
    return F.min(signature) == F.max(signature)


def latest_copy(copies: DataFrame, group: list[str], stamp: str | None) -> DataFrame:
    """(src, pk) of the newest copy, first encountered on a tie; the first copy without a stamp."""
    if stamp is None:
        best = F.min(F.struct("src", "pk"))
    else:
        best = F.max_by(F.struct("src", "pk"), F.struct(F.col(stamp), -F.col("src"), -F.col("pk")))
    return copies.groupBy(*group).agg(best.alias("_w")).select(
        *group, F.col("_w.src").alias("win_src"), F.col("_w.pk").alias("win_pk")
    )


# How the lead among candidates was decided, as shown next to a suggestion.
REASONS = {
    "row": "the most recent edit of this row",
    "backup": "edit times are equal, so the most recently changed snapshot",
    "snapshot": "rows of this table carry no edit time, so the most recently changed snapshot",
    "tie": "all times are equal, so the first snapshot",
}


def suggest_winner(candidates: DataFrame, group: list[str], by_row: bool) -> DataFrame:
    """Newest candidate per conflict and what decided it.

    ``candidates`` has ``src, pk, label, row_ts, backup_ts`` (the last two from ``ts_key``).
    With ``by_row`` the row time leads and the snapshot time breaks ties; otherwise only the
    snapshot time counts. The first candidate wins a full tie.
    """
    rank = F.struct("row_ts", "backup_ts") if by_row else F.struct("backup_ts")
    ranked = candidates.select(
        *group, "src", "pk", "label", F.struct("src", "pk").alias("pos"), rank.alias("rank"),
        (F.col("row_ts") if by_row else F.col("backup_ts")).alias("lead"),
    )
    best = ranked.groupBy(*group).agg(
        F.max_by(F.struct("pos", "rank", "lead", "label"), F.struct("rank", -F.col("src"), -F.col("pk"))).alias("b"),
        agreement("rank").alias("tie"),
        F.count("*").alias("n_candidates"),
    )
    # What decided: against the best earlier candidate when there is one (all earlier ones
    # are smaller, the winner being the first of the largest), else against the first smaller one.
    earlier = F.when(F.col("pos") < F.col("b.pos"), F.col("lead"))
    smaller = F.when(F.col("rank") < F.col("b.rank"), F.col("pos"))
    decided = ranked.join(best.select(*group, "b"), group).groupBy(*group).agg(
        F.max(earlier).alias("lead_before"),
        F.min_by(F.col("lead") < F.col("b.lead"), smaller).alias("first_by_lead"),
    )
    by_lead = F.coalesce(F.col("lead_before") < F.col("b.lead"), F.col("first_by_lead"))
    code = F.when(F.col("tie"), "tie")
    code = code.when(by_lead, "row").otherwise("backup") if by_row else code.otherwise("snapshot")
    texts = F.create_map(*[F.lit(v) for item in REASONS.items() for v in item])
    return best.join(decided, group).withColumn("decided_by", code).select(
        *group, "n_candidates",
        F.col("b.pos.src").alias("suggested_src"),
        F.col("b.pos.pk").alias("suggested_pk"),
        "decided_by",
        F.concat(F.col("b.label"), F.lit(": "), texts[F.col("decided_by")]).alias("reason"),
    )


def apply_choices(conflicts: DataFrame, candidates: DataFrame, resolutions: DataFrame | None, scope: list[str]) -> DataFrame:
    """Decide every conflict: an explicit choice that names a candidate, else the suggestion.

    ``resolutions`` has ``[*scope, conflict_id, choice]`` with a source ordinal, or -1 to keep
    all copies (notes and highlights only). Adds ``win_src, win_pk, was_suggested, kept_both,
    overridden``.
    """
    key = [*scope, "conflict_id"]
    if resolutions is None:
        chosen = conflicts.withColumn("choice", F.lit(None).cast("int"))
    else:
        chosen = conflicts.join(resolutions.select(*key, F.col("choice").cast("int").alias("choice")), key, "left")
    holders = candidates.groupBy(*key, F.col("src").alias("choice")).agg(F.min("pk").alias("_choice_pk"))
    decided = chosen.join(holders, [*key, "choice"], "left")
    keep = (F.coalesce(F.col("choice"), F.lit(0)) == -1) & F.col("kind").isin("note", "userMark")
    taken = F.col("_choice_pk").isNotNull()
    return (
        decided.withColumn("win_src", F.when(taken, F.col("choice")).otherwise(F.col("suggested_src")))
        .withColumn("win_pk", F.when(taken, F.col("_choice_pk")).otherwise(F.col("suggested_pk")))
        .withColumn("was_suggested", F.col("win_src") == F.col("suggested_src"))
        .withColumn("kept_both", keep)
        .withColumn("overridden", F.coalesce(F.col("choice") != F.col("suggested_src"), F.lit(False)))
        .drop("_choice_pk")
    )


def update_resolutions(current: DataFrame, edits: DataFrame, scope: list[str]) -> DataFrame:
    """Upsert decisions by conflict id; an edit with a null choice resets to the suggestion.

    ``edits`` has ``[*scope, conflict_id, choice, seq]``; the highest ``seq`` counts.
    """
    key = [*scope, "conflict_id"]
    both = current.select(*key, "choice", F.lit(-1).cast("bigint").alias("seq")).unionByName(
        edits.select(*key, "choice", F.col("seq").cast("bigint").alias("seq"))
    )
    last = both.groupBy(*key).agg(F.max_by("choice", "seq").alias("choice"))
    return last.where("choice IS NOT NULL")


def mark_identical(candidates: DataFrame, group: list[str], content: Column) -> DataFrame:
    """Label of the first earlier candidate with the same content, null when there is none."""
    tagged = candidates.withColumn("_content", content)
    first = tagged.groupBy(*group, "_content").agg(F.min(F.struct("src", "pk", "label")).alias("_f"))
    joined = tagged.join(first, [*group, "_content"])
    same = (F.col("_f.src") == F.col("src")) & (F.col("_f.pk") == F.col("pk"))
    return joined.withColumn("same_as", F.when(~same, F.col("_f.label"))).drop("_content", "_f")
