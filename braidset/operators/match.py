"""Identity matching across sources.

Input rows have ``[*scope, "src", "pk"]`` (``pk`` numeric, unique inside a source) and
a non-null key column. Encounter order is (src, pk). An entity is known by the row that
created it (``ent_src``, ``ent_pk``); dense global ids follow the order of creation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from braidset.operators.components import components
from braidset.operators.ordinals import ordinal_within
from braidset.session import materialize

#: Rows of a component that one task streams through; its keys are held in memory.
STREAMED = 200_000


def allocate_ids(entities: DataFrame, scope: list[str], order: list[str], out: str = "gid") -> DataFrame:
    """Dense ids from 1 per scope in the given order."""
    return ordinal_within(entities, scope, order, out)


def match_by_key(rows: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Occurrence match: the n-th row of a key in a source is the n-th entity of that key.

    Two rows of one source thus never meet, and no self-join is needed. Returns
    ``[*scope, src, pk, ent_src, ent_pk]``.
    """
    slim = rows.select(*scope, "src", "pk", F.col(key).alias("_key"))
    placed = ordinal_within(slim, [*scope, "src", "_key"], ["pk"], "_occ")
    first = placed.groupBy(*scope, "_key", "_occ").agg(F.min(F.struct("src", "pk")).alias("_e"))
    joined = placed.join(first, [*scope, "_key", "_occ"])
    return joined.select(*scope, "src", "pk", F.col("_e.src").alias("ent_src"), F.col("_e.pk").alias("ent_pk"))


def keep_ids(tops: DataFrame) -> Callable[..., DataFrame]:
    """An ``allocate_ids`` for source 0 being an earlier result: its entities keep their own ids.

    All others follow, in order, above ``tops`` (``[*scope, _top]``, the highest id of that result; none counts as 0).
    """
    def allocate(entities: DataFrame, scope: list[str], order: list[str], out: str = "gid") -> DataFrame:
        src, pk = ("ent_src", "ent_pk") if "ent_src" in entities.columns else ("src", "pk")
        kept = entities.where(F.col(src) == 0).withColumn(out, F.col(pk).cast("bigint"))
        new = ordinal_within(entities.where(F.col(src) != 0), scope, order, out)
        key = scope or ["_one"]  # without a scope a single row, met by a constant key
        high = tops if scope else F.broadcast(tops.withColumn("_one", F.lit(1)))
        new = new.withColumn("_one", F.lit(1)).join(high, key, "left").withColumn(out, F.col(out) + F.coalesce("_top", F.lit(0)))
        return kept.unionByName(new.select(*kept.columns))

    return allocate


def number_entities(matched: DataFrame, scope: list[str], allocate: Callable[..., DataFrame] = allocate_ids) -> DataFrame:
    """Add ``gid`` to rows matched to entities."""
    matched = materialize(matched, "matched")
    created = matched.where((F.col("src") == F.col("ent_src")) & (F.col("pk") == F.col("ent_pk")))
    ids = allocate(created.select(*scope, "ent_src", "ent_pk"), scope, ["ent_src", "ent_pk"])
    return matched.join(ids, [*scope, "ent_src", "ent_pk"])


def match_or_allocate(rows: DataFrame, scope: list[str], key: list[str], allocate: Callable[..., DataFrame] = allocate_ids) -> DataFrame:
    """One entity per key, whoever holds it: ``[*scope, *key, gid, ent_src, ent_pk]``, one row per key."""
    first = rows.groupBy(*scope, *key).agg(F.min(F.struct("src", "pk")).alias("_e"))
    flat = first.select(*scope, *key, F.col("_e.src").alias("ent_src"), F.col("_e.pk").alias("ent_pk"))
    return allocate(flat, scope, ["ent_src", "ent_pk"])


def match_multi_key(rows: DataFrame, scope: list[str], place: str, media: str, full: str, streamed: int = STREAMED) -> DataFrame:
    """Match on several identity keys, tried in order, all keys of a row naming its entity.

    ``place`` and ``media`` are constraint keys: not repeated inside a source, null when
    not live, and functions of the columns in ``full``. Rows whose constraint keys each
    meet only one full key need nothing but the occurrence match on ``full``. The others fall into components of
    rows that share keys; components do not depend on one another. Up to ``streamed`` rows, a component is matched in one task
    that streams it in order and holds its keys; a larger one takes a distributed round for each of its sources.
    """
    slim = rows.select(*scope, "src", "pk", F.col(place).alias("_t"), F.col(media).alias("_m"), F.col(full).alias("_f"))
    crossing = _tangled(slim, scope)
    plain = slim.join(crossing, [*scope, "_f"], "left_anti")
    tangled = materialize(slim.join(crossing, [*scope, "_f"], "left_semi").withColumn("_row", F.monotonically_increasing_id()), "tangled")
    labelled = _labelled(tangled, scope)
    sizes = labelled.groupBy("_component").agg((F.count("*") <= streamed).alias("_small"))
    labelled = materialize(labelled.join(sizes, "_component"), "tangled-components")
    small, large = labelled.where("_small"), labelled.where("NOT _small")
    return match_by_key(plain, scope, "_f").unionByName(_match_streamed(small, scope)).unionByName(_match_in_rounds(large, scope))


def _tangled(slim: DataFrame, scope: list[str]) -> DataFrame:
    """Full keys that share a constraint key with another full key."""
    def shared(key: str) -> DataFrame:
        live = slim.where(F.col(key).isNotNull())
        spread = live.groupBy(*scope, key).agg(F.min("_f").alias("_lo"), F.max("_f").alias("_hi"))
        return live.join(spread.where("_lo <> _hi").select(*scope, key), [*scope, key], "left_semi")

    both = shared("_t").select(*scope, "_f").unionByName(shared("_m").select(*scope, "_f"))
    return both.distinct()


def _keyed(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each live key, with the rank in which it is tried."""
    keys = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.col(c).alias("key")) for i, c in enumerate(("_t", "_m", "_f"))])
    return rows.select(*more, F.explode(keys).alias("k")).select(*more, "k.rank", "k.key").where("key IS NOT NULL")


def _labelled(tangled: DataFrame, scope: list[str]) -> DataFrame:
    """``tangled`` with ``_component``: rows that share a key, directly or over others."""
    keyed = _keyed(tangled, *scope, "_row")
    stars = keyed.join(keyed.groupBy(*scope, "rank", "key").agg(F.min("_row").alias("_first")), [*scope, "rank", "key"])
    roots = components(stars.select("_row", "_first"), "_row", "_first").select(F.col("node").alias("_row"), F.col("root").alias("_component"))
    return tangled.join(roots, "_row", "left").withColumn("_component", F.coalesce("_component", "_row"))


def _match_streamed(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Ordered matching of whole components, each in the task its rows stream through."""
    kind = lambda c: rows.schema[c].dataType.simpleString()
    out = ", ".join([*(f"{c} {kind(c)}" for c in [*scope, "src", "pk"]), f"ent_src {kind('src')}", f"ent_pk {kind('pk')}"])
    slim = rows.select("_component", "src", "pk", "_t", "_m", "_f", *scope)
    ordered = slim.repartition("_component").sortWithinPartitions("_component", "src", "pk")
    return ordered.mapInPandas(lambda batches: _stream(batches, scope), out)


def _stream(batches: Iterator[pd.DataFrame], scope: list[str]) -> Iterator[pd.DataFrame]:
    """Each row takes the entity first listed under its first known key, of the sources before its own, and lists all its keys."""
    component = source = None
    known: dict[tuple, tuple] = {}
    waiting: list[tuple] = []
    for batch in batches:
        entities = []
        for row in zip(batch["_component"], batch["src"], batch["pk"], batch["_t"], batch["_m"], batch["_f"]):
            if row[0] != component:
                component, source, known, waiting = row[0], row[1], {}, []
            elif row[1] != source:
                for key, entity in waiting:
                    known.setdefault(key, entity)
                source, waiting = row[1], []
            keys = [(i, k) for i, k in enumerate(row[3:]) if isinstance(k, str)]
            entity = next((known[k] for k in keys if k in known), (row[1], row[2]))
            waiting += [(k, entity) for k in keys]
            entities.append(entity)
        found = batch[[*scope, "src", "pk"]].copy()
        found["ent_src"], found["ent_pk"] = [e[0] for e in entities], [e[1] for e in entities]
        yield found


def _match_in_rounds(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Ordered matching with one distributed round for each place of a source in its component.

    Constraint keys do not repeat inside a source and tangled rows all have one, so the rows of one source cannot compete and each
    takes the oldest entity listed under its first key that is known. A round adds its keys to the index as a table of its own.
    """
    none = rows.select(*scope, "src", "pk", F.col("src").alias("ent_src"), F.col("pk").alias("ent_pk")).limit(0)
    if rows.isEmpty():
        return none
    places = ordinal_within(rows.select("_component", "src").distinct(), ["_component"], ["src"], "_round")
    rows = materialize(rows.join(places, ["_component", "src"]), "tangled-rounds")
    found, index = [], []
    for turn in range(1, rows.agg(F.max("_round")).first()[0] + 1):
        keyed = _keyed(rows.where(F.col("_round") == turn), "_component", *scope, "src", "pk")
        if index:
            listed = reduce(DataFrame.unionByName, index).groupBy("_component", "rank", "key").agg(F.min(F.struct("_round", "src", "pk", "ent_src", "ent_pk")).alias("e"))
            keyed = keyed.join(listed, ["_component", "rank", "key"], "left")
            hit = keyed.groupBy("_component", *scope, "src", "pk").agg(F.min_by("e", F.when(F.col("e").isNotNull(), F.col("rank"))).alias("e"))
            entity = [F.coalesce("e.ent_src", "src").alias("ent_src"), F.coalesce("e.ent_pk", "pk").alias("ent_pk")]
        else:
            hit, entity = keyed.select("_component", *scope, "src", "pk").distinct(), [F.col("src").alias("ent_src"), F.col("pk").alias("ent_pk")]
        hit = materialize(hit.select("_component", *scope, "src", "pk", *entity), "tangled-round")
        found.append(hit.select(*none.columns))
        own = _keyed(rows.where(F.col("_round") == turn), "_component", "_round", *scope, "src", "pk")
        index.append(materialize(own.join(hit, ["_component", *scope, "src", "pk"]).select("_component", "rank", "key", "_round", "src", "pk", "ent_src", "ent_pk"), "tangled-keys"))
    return reduce(DataFrame.unionByName, found)
