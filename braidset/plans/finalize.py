"""Apply decisions to an analysis: merged rows, winners, kept copies, decision log."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from braidset import schema
from braidset.functions.hashing import stable_guid
from braidset.operators.conflicts import apply_choices
from braidset.operators.ordinals import ordinal_within
from braidset.plans.analyze import Analysis
from braidset.session import materialize


@dataclass
class Result:
    """Final tables (``[*scope, *registry columns]``) and one decision row per conflict."""

    tables: Mapping[str, DataFrame]
    decisions: DataFrame
    scope: list[str]


class _Final(Result):
    """A result whose decisions are made with the first table that needs them, or when they are asked for."""

    def __init__(self, tables: FinalTables) -> None:
        self.tables, self.scope = tables, tables.analysis.scope

    @cached_property
    def decisions(self) -> DataFrame:
        return self.tables.decided.select(
            *self.scope, "conflict_id", "kind", F.col("win_src").alias("winner_src"), "was_suggested", "kept_both", "overridden",
            "suggested_src", "n_candidates",
        )


class FinalTables(Mapping):
    """All final tables by name, each made when it is first asked for, as are the decisions; see ``finalize``."""

    def __init__(self, analysis: Analysis, resolutions: DataFrame | None, apart: bool = False) -> None:
        self.analysis, self.resolutions, self.with_kept, self.made = analysis, resolutions, resolutions is not None, {}
        self.apart, self._of = apart, {}
        self.guid = stable_guid(F.concat_ws(":", "conflict_id", F.col("src").cast("string")))

    @cached_property
    def decided(self) -> DataFrame:
        a = self.analysis
        if self.apart:
            return reduce(DataFrame.unionByName, [self.decided_of(kind) for kind in a.CONFLICTS])
        return materialize(apply_choices(a.conflicts, a.candidates, self.resolutions, a.scope), "decisions")

    def decided_of(self, kind: str) -> DataFrame:
        """Decisions of one kind, made from the conflicts of that kind alone."""
        if kind not in self._of:
            a = self.analysis
            made = apply_choices(a.conflicts_of(kind), a.candidates_of(kind), self.resolutions, a.scope)
            self._of[kind] = materialize(made, f"decisions-{kind}")
        return self._of[kind]

    def verdict(self, table: str) -> DataFrame:
        """Winners of the conflicts of a table."""
        decided = self.decided_of(self.analysis.KINDS[table]) if self.apart else self.decided
        return decided.select(*self.analysis.scope, "conflict_id", "win_src", "win_pk", "kept_both")

    def __iter__(self) -> Iterator[str]:
        return iter(schema.TABLES)

    def __len__(self) -> int:
        return len(schema.TABLES)

    def __contains__(self, name: object) -> bool:
        return name in schema.TABLES

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            how = {"UserMark": self._marks, "Note": self._notes, "InputField": self._fields, "BlockRange": self._ranges}.get(name)
            # Counts, reference checks and health checks read these tables many times; the others are stage tables already.
            self.made[name] = self.analysis.merged(name) if how is None else materialize(how(), f"final-{name}")
        return self.made[name]

    def _judged(self, table: str) -> DataFrame:
        candidates = self.analysis.stage(table).extra["candidates"].join(self.verdict(table), [*self.analysis.scope, "conflict_id"])
        return candidates.withColumn("wins", (F.col("src") == F.col("win_src")) & (F.col("pk") == F.col("win_pk")))

    def _won(self, table: str) -> DataFrame:
        winners = self._judged(table).where("wins").select(*self.analysis.scope, *schema.columns(table))
        return self.analysis.merged(table).unionByName(winners)

    def _fields(self) -> DataFrame:
        return self._won("InputField")

    def _notes(self) -> DataFrame:
        tables = self._won("Note")
        if not self.with_kept:
            return tables
        notes = _fresh(self.analysis, self._judged("Note").where("kept_both AND NOT wins"), "Note", ["gid", "src", "pk"])
        notes = notes.withColumn("NoteId", F.col("fresh")).withColumn("Guid", self.guid)
        return tables.unionByName(notes.select(*self.analysis.scope, *schema.columns("Note")))

    @cached_property
    def _kept_marks(self) -> DataFrame:
        return materialize(
            _fresh(self.analysis, self._judged("UserMark").where("kept_both AND NOT wins"), "UserMark", ["gid", "src", "pk"]),
            "kept-marks",
        )

    def _marks(self) -> DataFrame:
        tables = self._won("UserMark")
        if not self.with_kept:
            return tables
        renamed = self._kept_marks.withColumn("UserMarkId", F.col("fresh")).withColumn("UserMarkGuid", self.guid)
        return tables.unionByName(renamed.select(*self.analysis.scope, *schema.columns("UserMark")))

    def _ranges(self) -> DataFrame:
        sc, columns = self.analysis.scope, schema.columns("BlockRange")
        children = self.analysis.block_range.extra["children"].join(self.verdict("UserMark"), [*sc, "conflict_id"])
        won = (F.col("src") == F.col("win_src")) & (F.col("mark_pk") == F.col("win_pk"))
        tables = self.analysis.merged("BlockRange").unionByName(children.where(won).select(*sc, *columns))
        if not self.with_kept:
            return tables
        owners = self._kept_marks.select(*sc, "conflict_id", "src", F.col("pk").alias("mark_pk"), F.col("fresh").alias("mark"))
        extra = children.where(F.col("kept_both") & ~won).join(owners, [*sc, "conflict_id", "src", "mark_pk"])
        ranges = _fresh(self.analysis, extra, "BlockRange", ["UserMarkId", "src", "mark_pk", "BlockRangeId"])
        ranges = ranges.withColumn("BlockRangeId", F.col("fresh")).withColumn("UserMarkId", F.col("mark"))
        return tables.unionByName(ranges.select(*sc, *columns))


def finalize(analysis: Analysis, resolutions: DataFrame | None = None, apart: bool = False) -> Result:
    """Merged rows plus the winners of all conflicts, plus every copy of those kept whole.

    Conflicts without a decision take their suggestion. A kept-whole conflict (choice -1)
    leaves its identity with the suggested copy; each other copy gets a fresh id and a GUID
    derived from the conflict and its source, and brings its own ranges along.

    A table is made when it is first asked for, with the stages of the analysis that it needs; tables without conflicts need no
    decisions. Given ``resolutions`` are read at once. With ``apart`` the decisions of each kind are made on their own, so that
    one table needs only those of its own conflicts.
    """
    tables = FinalTables(analysis, resolutions, apart)
    if resolutions is not None:
        tables.decided  # noqa: B018  (written now)
    return _Final(tables)


def _fresh(analysis: Analysis, rows: DataFrame, table: str, order: list[str]) -> DataFrame:
    """Ids above everything the analysis allocated for a table, in the given order."""
    sc, pk = analysis.scope, schema.primary_key(table)[0]
    used = [analysis.merged(table).select(*sc, F.col(pk).alias("_id"))]
    if table == "BlockRange":
        used.append(analysis.block_range.extra["children"].select(*sc, F.col(pk).alias("_id")))
    else:
        used.append(analysis.stage(table).extra["candidates"].select(*sc, F.col(pk).alias("_id")))
    if table in analysis.tops:
        used.append(analysis.tops[table].withColumnRenamed("_top", "_id"))
    top = reduce(DataFrame.unionByName, used).groupBy(*sc).agg(F.max("_id").alias("_top"))
    numbered = ordinal_within(rows, sc, order, "_k")
    if sc:
        joined = numbered.join(top, sc, "left")
    else:  # a single row, met by a constant key
        one = F.lit(1).alias("_one")
        joined = numbered.select("*", one).join(F.broadcast(top.select("*", one)), "_one", "left").drop("_one")
    return joined.withColumn("fresh", F.coalesce("_top", F.lit(0)) + F.col("_k")).drop("_top", "_k")


def sort_by_key(df: DataFrame, table: str) -> DataFrame:
    """Deterministic output order of a table."""
    return df.orderBy(*schema.primary_key(table))


def table_counts(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows per table and key: ``[*keys, table, n]``; tables without rows have no line."""
    parts = [
        tables[name].groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.lit(name).alias("table"), "n")
        for name in schema.TABLES if name in tables
    ]
    return reduce(DataFrame.unionByName, parts).where("n > 0")
