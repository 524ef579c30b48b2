"""Near-duplicate embeddings by NN-descent.

Equal vectors are one class. The neighbour graph begins with the best partners inside leaves of random hyperplanes; then rounds of
local joins compare the neighbours of each vector, forward and reverse, with one another and keep the best ``K``. Every
compared pair at the threshold is a link, whether or not it is among the ``K``; links are checked in double precision. A further pass
with new leaves lists partners outside a vector's component only, so that groups of more than ``K`` near copies don't fill the lists.
Components are compared block by block and counted, not listed. Passes end when one joins no components and an audit,
which compares a fixed number of vectors with all others, holds; if it still fails after ``PASSES``, all vectors are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from braidset.llm.common import components, dealt, paired_blocks, whole_groups
from braidset.session import materialize

THRESHOLD = 0.9
K = 8
TREES = 10
ROUNDS = 2
LEAF = 96
#: Rows of one local join or one block of a component.
GROUP, BLOCK = 48, 128
AUDIT, RECALL, PASSES = 256, 0.98, 3
#: Vectors compared with all others at once, where all are.
CHUNK = 8192
_MARGIN = 0.004  # more than half precision can be off


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, dim, unit) of the usable vectors; ``unit`` is the vector of length 1 as doubles."""
    for batch in batches:
        cid, unit, dim = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
            top = np.abs(x).max() if len(x) else 0.0
            if top > 0 and np.isfinite(top):
                x = x / top
                cid.append(i)
                dim.append(len(x))
                unit.append((x / np.sqrt((x * x).sum())).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], ["cid", "dim", "unit"])


def _stack(cells: np.ndarray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1)


def _leaves(batches: Iterator[pa.RecordBatch], bits: int, trees: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A row for each vector and tree: the leaf is the side of ``bits`` random hyperplanes."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim in set(batch.column(1).to_pylist()):
            part = batch.filter(pa.array(np.array(batch.column(1)) == dim))
            if dim not in planes:
                planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, bits * trees))
            x = _stack(part.column(2).to_numpy(zero_copy_only=False), "<f8")
            sides = (x @ planes[dim] > 0).reshape(len(x), trees, bits)
            code = (sides * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
            half = pa.array([h.tobytes() for h in x.astype("<f2")], pa.binary())
            root = part.column(3)
            for tree in range(trees):
                leaf = (np.int64(tree) << 56) | (np.int64(dim % (1 << 12)) << 44) | code[:, tree]
                yield pa.RecordBatch.from_arrays([pa.array(leaf), part.column(0), half, root], ["leaf", "cid", "half", "root"])


def best_partners(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` most similar distinct ``b`` of each ``a``; smaller ids on ties."""
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    first = np.sort(np.unique(np.stack([a, b]), axis=1, return_index=True)[1]) if len(a) else order
    a, b, sim = a[first], b[first], sim[first]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else order
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return a[rank < k], b[rank < k], sim[rank < k]


def _tree(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label of the component of each row of a symmetric matrix, and the ends of a forest's edges."""
    label = np.arange(len(near))
    free = near.any(axis=1)
    a, b = [], []
    for start in np.flatnonzero(free).tolist():
        if not free[start]:
            continue
        free[start] = False
        waiting = [start]
        while waiting:
            at = waiting.pop()
            new = np.flatnonzero(near[at] & free)
            free[new] = False
            label[new] = start
            a.append(np.full(len(new), at))
            b.append(new)
            waiting.extend(new.tolist())
    none = np.zeros(0, np.int64)
    return label, np.concatenate(a or [none]), np.concatenate(b or [none])


def _local_join(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Compare the vectors of each group (two key columns, cid, half, root) with one another.

    Gives the best partners of each in other components; and as links all pairs at the threshold between components: a forest
    of those that are certain, and each that half precision leaves open and the forest does not join.
    """
    for columns, starts in whole_groups(batches, 2):
        out: tuple[list, list, list] = ([], [], [])
        links: tuple[list, list, list] = ([], [], [])
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            root = columns[4][lo:hi]
            if hi - lo < 2 or (root == root[0]).all() or len({len(h) for h in columns[3][lo:hi]}) > 1:
                continue
            ids, x = columns[2][lo:hi], _stack(columns[3][lo:hi], "<f2").astype(np.float32)
            sims = x @ x.T
            sims[root[:, None] == root[None, :]] = -2
            near = np.argpartition(-sims, min(k, hi - lo - 1) - 1, axis=1)[:, :k]
            row = np.repeat(np.arange(hi - lo), near.shape[1])
            out[0].append(ids[row])
            out[1].append(ids[near.ravel()])
            out[2].append(sims[row, near.ravel()])
            if sims.max() >= threshold - _MARGIN:
                label, a, b = _tree(sims >= threshold + _MARGIN)
                u, v = np.nonzero(np.triu(sims >= threshold - _MARGIN) & (label[:, None] != label[None, :]))
                for to, of in zip(links, (ids[np.concatenate([a, u])], ids[np.concatenate([b, v])], sims[np.concatenate([a, u]), np.concatenate([b, v])])):
                    to.append(of)
        if out[0]:
            a, b, sim = (np.concatenate(x) for x in out)
            keep = sim > -2
            best = best_partners(a[keep], b[keep], sim[keep], k)
            linked = [(tuple(np.concatenate(x) for x in links), True)] if links[0] else []
            for (a, b, sim), link in [(best, False), *linked]:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim.astype(np.float32)), pa.array(np.full(len(a), link))], ["a", "b", "sim", "link"])


def _joined(rows: DataFrame, keys: list[str], k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Best partners (a, b, sim) and links (a, b) of the groups."""
    grouped = rows.select(*keys, "cid", "half", "root").repartition(*keys).sortWithinPartitions(*keys)
    found = materialize(grouped.mapInArrow(lambda batches: _local_join(batches, k, threshold), "a long, b long, sim float, link boolean"), "joined")
    return found.where("NOT link").drop("link"), found.where("link").select("a", "b")


def _best(graph: DataFrame, k: int) -> DataFrame:
    once = graph.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))
    return materialize(once.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank"), "neighbours")


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        half = [np.frombuffer(u, "<f8").astype("<f2").tobytes() for u in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(half, pa.binary()), batch.column(2)], ["cid", "half", "root"])


def neighbour_graph(units: DataFrame, n: int, threshold: float = THRESHOLD, k: int = K, trees: int = TREES, rounds: int = ROUNDS, seed: int = 1, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, sim): about the ``k`` nearest in other components of every vector of ``units`` (cid, dim, unit, root); and
    (a, b): pairs of vectors that may be links, enough to join all components with compared pairs at the threshold."""
    bits = min(40, max(0, int(np.ceil(np.log2(max(1, n) / LEAF)))))
    leaves = units.select("cid", "dim", "unit", "root").mapInArrow(lambda batches: _leaves(batches, bits, trees, seed), "leaf long, cid long, half binary, root long")
    graph, links = _joined(dealt(leaves, ["leaf"], F.struct("leaf", "cid"), LEAF * 2), ["leaf", "block"], k, threshold)
    graph = _best(graph if known is None else graph.unionByName(known), k)
    halves = materialize(units.select("cid", "unit", "root").mapInArrow(_halves, "cid long, half binary, root long"), "halves")
    for turn in range(rounds):
        members = graph.select(F.col("a").alias("at"), F.col("b").alias("cid")).unionByName(graph.select(F.col("b").alias("at"), F.col("a").alias("cid"))).distinct()
        lists = dealt(members, ["at"], F.struct(F.lit(seed * 100 + turn), F.col("cid")), GROUP)
        found, more = _joined(lists.join(halves, "cid"), ["at", "block"], k, threshold)
        graph, links = _best(graph.unionByName(found), k), links.unionByName(more)
    return graph, links


def _dot(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.array(batch.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3))
            same = np.array([len(p) == len(q) for p, q in zip(x, y)], bool)
            sims = np.array([np.dot(np.frombuffer(p, "<f8"), np.frombuffer(q, "<f8")) if s else -1.0 for p, q, s in zip(x, y, same)])
            yield batch.select([0, 1]).filter(pa.array(sims >= threshold))


def _count_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per vector of the first role, how many vectors (class sizes counted) of the second are linked to it."""
    for columns, starts in whole_groups(batches, 3):
        ids, links = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            role = columns[3][lo:hi]
            x = _stack(columns[6][lo:hi], "<f8")
            left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
            if len(left) and len(right):
                near = (x[left] @ x[right].T >= threshold) & (columns[4][lo:hi][left][:, None] != columns[4][lo:hi][right][None, :])
                ids.append(columns[4][lo:hi][left])
                links.append(near @ columns[5][lo:hi][right])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links).astype(np.int64))], ["cid", "links"])


def count_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(cid, links) over ``members`` (root, cid, n, unit): every pair of blocks of a component is compared as one group."""
    blocked = dealt(members, ["root"], F.col("cid"), block)
    placed = blocked.select("root", paired_blocks().alias("_place"), "cid", "n", "unit").select("root", "_place.*", "cid", "n", "unit")
    grouped = placed.repartition("root", "rb", "vb").sortWithinPartitions("root", "rb", "vb")
    counted = grouped.mapInArrow(lambda batches: _count_links(batches, threshold), "cid long, links long")
    return counted.groupBy("cid").agg(F.sum("links").alias("links"))


def _rooted(units: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return units.withColumn("root", F.col("cid"))
    rooted = units.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    return materialize(rooted, "rooted")


def audit_recall(units: DataFrame, roots: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """Recall of the true links of a sample, as a mean over vectors that have any: a link is found if its ends share a component.

    ``sample`` vectors each (fixed number, drawn by hash) are taken of those without a link, of components up to a
    hundredth of all, and of larger ones. The first two are weighed by how many they stand for; the result is the lower
    one of theirs and of the large components', so that neither hides the other. The sample is compared with every vector.
    """
    labelled = _rooted(units, roots)
    sizes = materialize(labelled.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    large = max(2.0, units.count() / 100)
    kind = F.when(F.col("size") == 1, 0).when(F.col("size") <= large, 1).otherwise(2)
    kinds = materialize(labelled.select("cid", "root").join(sizes, "root").select("cid", kind.alias("kind")), "kinds")
    stands = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    drawn = []
    for which in stands:
        ids = kinds.where(F.col("kind") == which).orderBy(F.xxhash64(F.lit("audit"), F.col("cid"))).limit(sample)
        drawn += [(which, r) for r in labelled.join(F.broadcast(ids), "cid").select("cid", "root", "unit").collect()]
    by_dim: dict[int, list] = {}
    for which, r in drawn:
        by_dim.setdefault(len(r["unit"]), []).append((r["cid"], r["root"], r["unit"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.array(batch.column(2).to_numpy(zero_copy_only=False))
            size = np.array(list(map(len, cells)))
            for width, rows in by_dim.items():
                at = np.flatnonzero(size == width)
                if not len(at):
                    continue
                own = np.array([r[0] for r in rows])
                near = _stack([r[2] for r in rows], "<f8") @ _stack(cells[at], "<f8").T >= threshold
                near &= own[:, None] != np.array(batch.column(0))[at][None, :]
                found = near & (np.array([r[1] for r in rows])[:, None] == np.array(batch.column(1))[at][None, :])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(near.sum(axis=1)), pa.array(found.sum(axis=1))], ["cid", "true", "found"])

    counted = labelled.select("cid", "root", "unit").mapInArrow(compare, "cid long, true long, found long").groupBy("cid").agg(F.sum("true").alias("t"), F.sum("found").alias("f"))
    share = {r["cid"]: r["f"] / r["t"] for r in counted.collect() if r["t"]}
    number = {which: sum(w == which for w, _ in drawn) for which in stands}

    def mean(*which: int) -> float:
        seen = [(stands[w] / number[w], share[r["cid"]]) for w, r in drawn if w in which and r["cid"] in share]
        return 1.0 if not seen else sum(w * s for w, s in seen) / sum(w for w, _ in seen)

    return min(mean(0, 1), mean(2))


def _across(batches: Iterator[pa.RecordBatch], rows: list, threshold: float) -> Iterator[pa.RecordBatch]:
    own = np.array([r["cid"] for r in rows]), np.array([r["root"] for r in rows])
    widths = np.array([len(r["unit"]) for r in rows])
    for batch in batches:
        cells = np.array(batch.column(2).to_numpy(zero_copy_only=False))
        size = np.array(list(map(len, cells)))
        cid, root = (np.array(batch.column(i)) for i in (0, 1))
        for width in np.unique(widths):
            mine, at = np.flatnonzero(widths == width), np.flatnonzero(size == width)
            x = _stack([rows[i]["unit"] for i in mine], "<f8")
            for lo in range(0, len(at), 512):
                some = at[lo:lo + 512]
                near = (x @ _stack(cells[some], "<f8").T >= threshold) & (own[1][mine][:, None] != root[some][None, :])
                u, v = np.nonzero(near)
                # One link for each pair of components is enough.
                _, first = np.unique(np.stack([own[1][mine][u], root[some][v]]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(own[0][mine][u[first]]), pa.array(cid[some][v[first]])], ["a", "b"])


def all_links(units: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links (a, b) between the components (root) of ``units`` from comparing all vectors, a chunk at a time: quadratic, but whole."""
    chunks = -(-n // CHUNK)
    found = []
    for chunk in range(chunks):
        rows = units.where(F.pmod(F.xxhash64(F.lit("chunk"), F.col("cid")), F.lit(chunks)) == chunk).select("cid", "root", "unit").collect()
        compared = units.select("cid", "root", "unit").mapInArrow(lambda batches, rows=rows: _across(batches, rows, threshold), "a long, b long")
        found.append(materialize(compared, "across"))
    return reduce(DataFrame.unionByName, found)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Cosine is taken in double precision between vectors of equal length. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing. Rows with equal vectors are linked to one another. A null vec_id counts as
    a link of others, names no component (unless alone: null) and is not kept. Rows that repeat a vec_id count one by one.
    An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("_hash", F.sha2(F.to_binary(F.array_join(
        F.transform("embedding", lambda c: F.coalesce((c + F.lit(0.0)).cast("string"), F.lit("null"))), ","), F.lit("utf-8")), 256))
    marked = materialize(rows.groupBy("_hash").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    units = materialize(marked.where(F.col("embedding").isNotNull()).select("cid", "embedding").mapInArrow(_units, "cid long, dim int, unit binary"), "units")
    n, graph, links, roots = units.count(), None, None, None
    for turn in range(PASSES):
        rooted = _rooted(units, roots)
        if graph is not None:
            ends = [rooted.select(F.col("cid").alias(c), F.col("root").alias("_" + c)) for c in "ab"]
            graph = graph.join(ends[0], "a").join(ends[1], "b").where("_a <> _b").select("a", "b", "sim")
        graph, compared = neighbour_graph(rooted, n, threshold, seed=turn + 1, known=graph)
        candidates = graph.where(F.col("sim") >= threshold - _MARGIN).select("a", "b").unionByName(compared)
        candidates = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = candidates.join(units.select(F.col("cid").alias("a"), F.col("unit").alias("x")), "a").join(units.select(F.col("cid").alias("b"), F.col("unit").alias("y")), "b")
        new = materialize(pairs.select("a", "b", "x", "y").mapInArrow(lambda batches: _dot(batches, threshold), "a long, b long"), "links")
        links = new if links is None else links.unionByName(new)
        whole = roots is not None and new.isEmpty()
        roots = roots if whole else components(links, "a", "b")
        if whole and audit_recall(units, roots, threshold) >= RECALL:
            break
    else:
        if audit_recall(units, roots, threshold) < RECALL:
            roots = components(links.unionByName(all_links(_rooted(units, roots), n, threshold)), "a", "b")
    members = roots.join(marked.select(F.col("cid").alias("node"), "n"), "node").join(units.select(F.col("cid").alias("node"), "unit"), "node")
    counted = count_links(members.select("root", F.col("node").alias("cid"), "n", "unit"), threshold)
    usable = units.select("cid", F.lit(True).alias("_usable"))
    named = marked.drop("embedding").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(counted, "cid", "left").join(usable, "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = materialize(named.join(names, "root").select(
        "_hash", "_usable", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-components")
    joined = rows.select("vec_id", "_hash").join(known, rows["_hash"].eqNullSafe(known["_hash"]))
    alone = F.col("_usable").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
