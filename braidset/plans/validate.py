"""Proof that a result is sound: references, row rules, unique keys, row counts, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from braidset import schema
from braidset.functions import keys as K

# Tables whose lower count bound only warns (ranges of losing highlight copies go).
SOFT_TABLES = ("BlockRange",)


def _complete(spark: SparkSession, counted: DataFrame, rows: list[tuple], ddl: str, by: list[str], keys: list[str]) -> DataFrame:
    """One line per registry row, zero where nothing was counted (only without key columns)."""
    if keys:
        return counted
    base = F.broadcast(spark.createDataFrame(rows, ddl))
    return base.join(counted, by, "left").withColumn("violations", F.coalesce("violations", F.lit(0).cast("bigint")))


def fk_violations(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows with a non-null reference to no row, per foreign key; one anti join per parent key.

    References are counted by the id they name before they meet the parents, and both sides are sorted where they meet: ids of a
    parent are small as files and large in memory, so they must not be broadcast by the size of their files.
    """
    spark = tables["Location"].sparkSession
    parents: dict[tuple, list] = {}
    for child, column, parent, pk in schema.FOREIGN_KEYS:
        parents.setdefault((parent, pk), []).append((child, column))
    parts = []
    for (parent, pk), children in parents.items():
        refs = reduce(DataFrame.unionByName, [
            tables[child].where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_ref"), F.lit(i).alias("_from"))
            for i, (child, column) in enumerate(children)
        ])
        named = refs.groupBy(*keys, "_ref").agg(*[F.count(F.when(F.col("_from") == i, 1)).alias(f"_{i}") for i in range(len(children))])
        known = tables[parent].select(*keys, F.col(pk).alias("_ref"))
        lost = named.join(known.hint("merge"), [*keys, "_ref"], "left_anti")
        lines = F.array(*[
            F.struct(F.lit(child).alias("table"), F.lit(column).alias("column"), F.col(f"_{i}").alias("violations"))
            for i, (child, column) in enumerate(children)
        ])
        summed = lost.groupBy(*keys).agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(children))])
        parts.append(summed.select(*keys, F.explode(lines).alias("l")).select(*keys, "l.*").where("violations > 0"))
    counted = reduce(DataFrame.unionByName, parts)
    rows = [(child, column) for child, column, _, _ in schema.FOREIGN_KEYS]
    return _complete(spark, counted, rows, "table string, column string", ["table", "column"], keys)


def constraint_violations(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows breaking a row rule or holding a null that is not allowed; one pass per table."""
    parts = []
    for table in schema.TABLES:
        rules = [(name, F.expr(f"NOT coalesce({rule}, true)")) for t, name, rule in schema.ROW_RULES if t == table]
        rules += [(f"{c} is set", F.col(c).isNull()) for c in schema.not_null_columns(table)]
        counts = [F.count(F.when(broken, 1)).alias(f"_{i}") for i, (_, broken) in enumerate(rules)]
        pairs = F.array(*[
            F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("violations")) for i, (name, _) in enumerate(rules)
        ])
        parts.append(tables[table].groupBy(*keys).agg(*counts).select(*keys, F.lit(table).alias("table"), F.explode(pairs).alias("p")).select(
            *keys, "table", "p.rule", "p.violations"
        ))
    return reduce(DataFrame.unionByName, parts)


def unique_violations(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Repeated keys per unique constraint and primary key; keys with a null part never repeat."""
    spark = tables["Location"].sparkSession
    constraints = [(t, "primary key", schema.primary_key(t)) for t in schema.TABLES] + list(schema.UNIQUE_KEYS)
    parts = []
    for table, name, exprs in constraints:
        names = [f"_k{i}" for i in range(len(exprs))]
        keyed = tables[table].select(*keys, *[F.expr(e).alias(n) for e, n in zip(exprs, names)]).dropna(subset=names)
        repeated = keyed.groupBy(*keys, *names).agg(F.count("*").alias("_n")).where("_n > 1")
        parts.append(repeated.groupBy(*keys).agg(F.count("*").alias("violations")).where("violations > 0").select(
            *keys, F.lit(table).alias("table"), F.lit(name).alias("constraint"), "violations"
        ))
    rows = [(t, n) for t, n, _ in constraints]
    return _complete(spark, reduce(DataFrame.unionByName, parts), rows, "table string, constraint string", ["table", "constraint"], keys)


def reconcile_counts(source_counts: DataFrame, dropped: DataFrame, final_counts: DataFrame, removed: DataFrame | None,
                     scope: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Per table: largest source <= final <= sum of sources, allowing for dropped and removed rows.

    ``source_counts`` is ``[*scope, src, table, n]``, ``dropped`` ``[*scope, src, table, dropped]``,
    ``final_counts`` ``[*scope, table, n]``, ``removed`` ``[*scope, table, removed]``.
    """
    by = [*scope, "table"]
    carried = source_counts.join(dropped, [*scope, "src", "table"], "left").withColumn(
        "_carried", F.greatest(F.lit(0).cast("bigint"), F.col("n") - F.coalesce("dropped", F.lit(0)))
    )
    bounds = carried.groupBy(*by).agg(
        F.max("n").alias("max_source"), F.max("_carried").alias("max_carried"), F.sum("n").alias("sum_source")
    )
    out = bounds.join(final_counts.withColumnRenamed("n", "final"), by, "full_outer")
    if removed is not None:
        out = out.join(removed, by, "left")
    else:
        out = out.withColumn("removed", F.lit(0).cast("bigint"))
    if expected is not None:
        out = out.join(expected.withColumnRenamed("n", "expected"), by, "full_outer")
    out = out.fillna(0, [c for c in out.columns if c not in by])
    upper = F.col("final") <= F.col("sum_source")
    lower = F.col("final") >= F.col("max_carried") - F.col("removed")
    soft = F.col("table").isin(*SOFT_TABLES)
    out = out.withColumn("upper_ok", upper).withColumn("lower_ok", lower).withColumn("ok", upper & (lower | soft))
    bound = F.when(
        F.col("max_carried") == F.col("max_source"), F.format_string("the largest source (%d)", "max_source")
    ).otherwise(F.format_string("what the largest source can give (%d of %d)", "max_carried", "max_source"))
    less = F.when(F.col("removed") > 0, F.format_string(" less %d cleaned up", "removed")).otherwise("")
    low = F.concat(F.col("table"), F.format_string(": %d rows are fewer than ", "final"), bound, less)
    errors = F.array(
        F.when(~upper, F.concat(F.col("table"), F.format_string(": %d rows are more than all sources hold (%d)", "final", "sum_source"))),
        F.when(~lower & ~soft, low),
        *([F.when(F.col("expected") != F.col("final"), F.concat(F.col("table"), F.format_string(": %d rows written, %d expected", "final", "expected")))]
          if expected is not None else []),
    )
    return out.withColumn("errors", F.filter(errors, lambda e: e.isNotNull())).withColumn(
        "warnings", F.filter(F.array(F.when(~lower & soft, low)), lambda w: w.isNotNull())
    )


def broken_rules(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Row rules and unique keys that some row breaks: ``[*keys, table, rule, violations]``."""
    single = unique_violations(tables, keys).select(*keys, "table", F.concat(F.lit("unique "), "constraint").alias("rule"), "violations")
    return constraint_violations(tables, keys).unionByName(single).where("violations > 0")


def same_contents(expected: dict[str, DataFrame], written: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Whether a result and what is read back of it hold the same rows: ``[*keys, table, same]``."""
    a, b = (fingerprint(t, keys).withColumnRenamed("digest", name).drop("n") for t, name in ((expected, "_a"), (written, "_b")))
    return a.join(b, [*keys, "table"], "full_outer").select(*keys, "table", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))


def validation_report(fk: DataFrame, counts: DataFrame, scope: list[str], roundtrip: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Verdict per scope with all errors and warnings (at most a few per table)."""
    broken = fk.groupBy(*scope).agg(F.sum("violations").alias("foreign_key_violations"))
    texts = counts.groupBy(*scope).agg(
        F.array_sort(F.flatten(F.collect_list("errors"))).alias("errors"),
        F.array_sort(F.flatten(F.collect_list("warnings"))).alias("warnings"),
        F.count(F.when(~F.col("ok"), 1)).alias("tables_off"),
    )
    one = scope or ["_one"]
    if not scope:
        broken, texts = (df.withColumn("_one", F.lit(1)) for df in (broken, texts))
    out = texts.join(broken, one, "left").withColumn("foreign_key_violations", F.coalesce("foreign_key_violations", F.lit(0).cast("bigint")))
    extra = F.array(F.when(F.col("foreign_key_violations") > 0, F.format_string("%d dangling reference(s)", "foreign_key_violations")))
    if roundtrip is not None:
        lost = roundtrip.groupBy(*scope).agg(F.count(F.when(~F.col("same"), 1)).alias("tables_changed"))
        lost = lost if scope else lost.withColumn("_one", F.lit(1))
        out = out.join(lost, one, "left")
        extra = F.concat(extra, F.array(F.when(F.col("tables_changed") > 0, F.lit("the written result reads back differently"))))
    if rules is not None:
        named = rules.groupBy(*scope).agg(F.count("*").alias("rules_broken"))
        named = named if scope else named.withColumn("_one", F.lit(1))
        out = out.join(named, one, "left").withColumn("rules_broken", F.coalesce("rules_broken", F.lit(0).cast("bigint")))
        extra = F.concat(extra, F.array(F.when(F.col("rules_broken") > 0, F.format_string("%d rule(s) broken", "rules_broken"))))
    out = out.withColumn("errors", F.concat("errors", F.filter(extra, lambda e: e.isNotNull())))
    return out.withColumn("ok", F.size("errors") == 0).drop("_one")


def check_roundtrip(expected: dict[str, DataFrame], written: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Counts of the result against those read back from storage."""
    from braidset.plans.finalize import table_counts

    a = table_counts(expected, keys).withColumnRenamed("n", "expected")
    b = table_counts(written, keys).withColumnRenamed("n", "final")
    both = a.join(b, [*keys, "table"], "full_outer").fillna(0, ["expected", "final"])
    return both.withColumn("same", F.col("expected") == F.col("final"))


def _slim_keys(table: str) -> tuple[list[Column], list[Column], Column]:
    """Keys of a table for joins with its lineage: of its rows, of local keys there (both ``_key, _null``), and of global keys there.

    Numbers travel as numbers, which are a third of their texts and sort faster.
    """
    no = F.lit(False).alias("_null")
    if len(schema.primary_key(table)) > 1:
        return [K.local_key(table).alias("_key"), no], [F.col("local_key").alias("_key"), no], F.col("global_key")
    own, text = F.col(schema.primary_key(table)[0]), F.col("local_key")
    none = text == K.NULL_TOKEN  # the text of a null id; a null text is the key of no row
    return (
        [F.coalesce(own, F.lit(0)).alias("_key"), own.isNull().alias("_null")],
        [F.when(none, F.lit(0)).otherwise(text.try_cast("bigint")).alias("_key"), none.alias("_null")], F.col("global_key").try_cast("bigint"))


def check_traceability(tables: dict[str, DataFrame], lineage: DataFrame, result: dict[str, DataFrame], decisions: DataFrame,
                       scope: list[str]) -> DataFrame:
    """Source rows without lineage, and mapped or winning rows missing from the result.

    Returns ``[*scope, table, untraced, missing, leaked, dropped]``; the first three must be zero.
    """
    # Table by table, so that keys meet only those of their own table; constant table names prune the lineage to one branch.
    parts = []
    for t in schema.TABLES:
        own = lineage.where(F.col("table") == t).select(*scope, "src", "local_key", "kind", "global_key", "conflict_id")
        local, key, other = _slim_keys(t)
        rows = tables[t].select(*scope, "src", *local)
        untraced = rows.join(own.select(*scope, "src", *key).hint("merge"), [*scope, "src", "_key", "_null"], "left_anti")
        # Dropped rows are nowhere in the result, and only conflicts of highlights can lose their rows, so only those meet decisions.
        live, lost = own.where("kind <> 'dropped'").select(*scope, "src", "kind", "conflict_id", other.alias("global_key")), F.lit(False)
        if t == "BlockRange":  # only here a losing copy's rows must not be in the result
            fought = live.where("kind = 'conflict'").join(decisions.select(*scope, "conflict_id", "winner_src"), [*scope, "conflict_id"], "left")
            fought = fought.select(*scope, "global_key", F.coalesce(F.col("winner_src") != F.col("src"), F.lit(False)).alias("_lost"))
            live = live.where("kind <> 'conflict'").select(*scope, "global_key", lost.alias("_lost")).unionByName(fought)
        else:
            live = live.select(*scope, "global_key", lost.alias("_lost"))
        held = F.col(schema.primary_key(t)[0]) if len(schema.primary_key(t)) == 1 else K.local_key(t)
        there = result[t].select(*scope, held.alias("global_key"), F.lit(True).alias("_in"))
        fate = live.join(there.hint("merge"), [*scope, "global_key"], "left").withColumn("_there", F.coalesce("_in", F.lit(False)))
        none = F.lit(0).cast("bigint")
        one = lambda condition: F.when(condition, 1).otherwise(0).cast("bigint")
        line = lambda df, **n: df.select(*scope, F.lit(t).alias("table"), *[
            n.get(c, none).alias(c) for c in ("untraced", "missing", "leaked", "dropped")])
        parts.append(line(untraced, untraced=one(F.lit(True))))
        parts.append(line(own.where("kind = 'dropped'"), dropped=one(F.lit(True))))
        parts.append(line(fate, missing=one(~F.col("_lost") & ~F.col("_there")), leaked=one(F.col("_lost") & F.col("_there"))))
    counted = reduce(DataFrame.unionByName, parts).groupBy(*scope, "table")
    return counted.agg(*[F.sum(c).alias(c) for c in ("untraced", "missing", "leaked", "dropped")])


def content_digest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-independent digest of rows per key: count plus a sum over row hashes.

    Each row is hashed with SHA-256; four 60-bit slices of the hash are summed exactly, as halves that stay below
    64 bits for billions of rows, and hashed again, so the state per group is constant and no row is gathered.
    """
    hashed = df.select(*keys, F.sha2(K.key_of(*columns), 256).alias("_row"))
    slices = hashed.select(*keys, *[F.conv(F.substring("_row", 1 + 16 * i, 15), 16, 10).cast("bigint").alias(f"_{i}") for i in range(4)])
    halves = [F.sum(half).alias(f"_{i}{name}") for i in range(4) for name, half in (
        ("h", F.shiftright(f"_{i}", 30)), ("l", F.col(f"_{i}").bitwiseAND(F.lit((1 << 30) - 1))))]
    whole = [
        (F.col(f"_{i}h").cast("decimal(27,0)") * F.lit(1 << 30).cast("decimal(10,0)") + F.col(f"_{i}l")).cast("decimal(38,0)").cast("string").alias(f"_{i}")
        for i in range(4)]
    summed = slices.groupBy(*keys).agg(F.count("*").alias("n"), *halves).select(*keys, "n", *whole)
    return summed.select(*keys, "n", F.sha2(F.concat_ws("/", F.col("n").cast("string"), *[f"_{i}" for i in range(4)]), 256).alias("digest"))


def fingerprint(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Digest per table: ``[*keys, table, n, digest]``; equal for equal contents in any order."""
    return reduce(DataFrame.unionByName, [
        content_digest(df, keys, [c for c in df.columns if c not in keys]).withColumn("table", F.lit(name)).where("n > 0")
        for name, df in tables.items()
    ])
