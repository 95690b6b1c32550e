"""Near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors are merged first, so that one vector with a third of all rows is one node.
Spherical k-means on a bounded sample gives cluster centres; every node joins the shards
of its ``overlap`` nearest ones. A shard of more than twice ``shard_size`` nodes is split the
same way, by centres of its own from a bounded sample of it, until none is, so that shards
keep their size however many vectors there are. In each shard a graph is built: every node gets edges to
near nodes and to far ones, each list robustly pruned (a candidate goes if a chosen one
is closer to it, by ``alpha``, than the node is), and edges back. A node's lists from
all its shards are united. Then every node is searched for from the shard's medoids:
best first for ``beam`` expansions, and on while nodes within range remain, however many.
Links found are verified in double precision.

A pair that shares several shards is reported by the first of them only, so that counts
add up without gathering pairs; for components a shard reports a spanning forest.

Recall is audited: a sample of nodes is compared with all others in blocks. It is the mean
over those that have links, so that a large cluster doesn't hide small ones. If it is less
than ``least_recall``, the whole is built again with more overlap, a wider beam, and larger
shards, which a dense cluster needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, require, slices, stage, unless_large
from .components import connected_components, stars
from .hashing import mix

_EXPANDED = 1_000_000  # edges followed at a time
NEAR, FAR = 16, 8  # edges of either kind before edges back are added


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of unit length; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == dims).all():
        x = flat.reshape(-1, dims)
    else:
        x = np.zeros((len(sizes), dims))
        x[np.arange(dims) < sizes[:, None]] = flat
    scale = np.abs(x).max(1, keepdims=True, initial=0)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means."""
    r = np.random.default_rng(7)
    c = sample[r.choice(len(sample), k, replace=False)]
    for _ in range(rounds if k > 1 else 1):
        of = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
        total = np.zeros_like(c)
        np.add.at(total, of, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def robust_prune(x: np.ndarray, near: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """near: (nodes, candidates) from the closest on, -1 for none. Returns (nodes, degree), -1 for none."""
    n, c = near.shape
    at = np.maximum(near, 0)
    gone = near < 0
    apart = 1 - np.einsum("nd,ncd->nc", x[:n], x[at])
    out, filled = np.full((n, degree), -1), np.zeros(n, np.int64)
    for j in range(c):
        rows = np.flatnonzero(~gone[:, j] & (filled < degree))
        out[rows, filled[rows]] = near[rows, j]
        filled[rows] += 1
        if j + 1 < c and len(rows):
            between = 1 - np.einsum("nd,ncd->nc", x[at[rows, j]], x[at[rows, j + 1 :]])
            gone[rows, j + 1 :] |= alpha * between < apart[rows, j + 1 :]
    return out


def build(x: np.ndarray, alpha: float, seed: int) -> np.ndarray:
    """Edges (a, b), both ways, of a shard's graph."""
    n = len(x)
    if n < 2:
        return np.empty((0, 2), np.int64)
    r, parts = np.random.default_rng(seed), []
    width = max(16, min(512, 4_000_000 // n))
    for low in range(0, n, width):
        rows = np.arange(low, min(n, low + width))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -2
        k = min(3 * NEAR, n - 1)
        near = np.argpartition(-sim, k - 1, 1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), 1), 1)
        far = r.integers(0, n, (len(rows), 3 * FAR))
        far = np.take_along_axis(far, np.argsort(-np.take_along_axis(sim, far, 1), 1), 1)
        far[far == rows[:, None]] = -1
        y = np.concatenate([x[rows], x])  # robust_prune takes its nodes from the front
        shift = lambda ids: np.where(ids < 0, -1, ids + len(rows))  # noqa: E731, B023
        for candidates, degree in ((near, NEAR), (far, FAR)):
            kept = robust_prune(y, shift(candidates), alpha, degree)
            a, j = np.nonzero(kept >= 0)
            parts.append(np.column_stack([rows[a], kept[a, j] - len(rows)]))
    edges = np.concatenate(parts)
    return np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0)


def search(x: np.ndarray, edges: np.ndarray, radius: float, beam: int, medoids: int = 8) -> np.ndarray:
    """Links (a, b) with cosine >= radius that searching for every node from medoids finds."""
    n = len(x)
    start = np.searchsorted(edges[:, 0], np.arange(n + 1))
    to = edges[:, 1]
    middle = np.argsort(-(x @ x.mean(0)), kind="stable")[: min(medoids, n)]
    found = []
    width = max(16, min(n, 4_000_000 // max(1, n)))
    for low in range(0, n, width):
        q = np.arange(low, min(n, low + width))
        score = np.full((len(q), n), -2.0)
        score[:, middle] = x[q] @ x[middle].T
        fresh = score.copy()  # of nodes seen and not expanded
        active, steps = np.arange(len(q)), np.zeros(len(q), np.int64)
        while len(active):
            best = fresh[active].argmax(1)
            top = fresh[active, best]
            go = (top > -2) & ((steps[active] < beam) | (top >= radius))
            active, best = active[go], best[go]
            if not len(active):
                break
            late = steps[active] >= beam  # all in range at once
            r, more = np.nonzero(fresh[active[late]] >= radius)
            rows, nodes = np.concatenate([active[~late], active[late][r]]), np.concatenate([best[~late], more])
            sizes = start[nodes + 1] - start[nodes]
            if sizes.sum() > _EXPANDED:  # the rest waits, and its steps with it
                upto = max(1, int(np.searchsorted(np.cumsum(sizes), _EXPANDED)))
                rows, nodes, sizes = rows[:upto], nodes[:upto], sizes[:upto]
            steps[np.unique(rows)] += 1
            fresh[rows, nodes] = -2
            qs = np.repeat(rows, sizes)
            ns = to[np.repeat(start[nodes], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            unseen = np.flatnonzero(score[qs, ns] == -2)
            flat = np.unique(qs[unseen] * n + ns[unseen])
            qs, ns = flat // n, flat % n
            for part in np.array_split(np.arange(len(qs)), max(1, len(qs) // 100_000)):
                score[qs[part], ns[part]] = fresh[qs[part], ns[part]] = np.einsum("ij,ij->i", x[q[qs[part]]], x[ns[part]])
        a, b = np.nonzero(score >= radius)
        found.append(np.column_stack([q[a], b]))
    links = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    links = links[links[:, 0] != links[:, 1]]
    return np.unique(np.sort(links, 1), axis=0)


def _nearest(x: np.ndarray, c: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, centre): the m nearest centres of each row."""
    m = min(m, len(c))
    sim = x @ c.T
    top = np.argpartition(-sim, m - 1, 1)[:, :m] if m < len(c) else np.tile(np.arange(m), (len(x), 1))
    return np.repeat(np.arange(len(x)), m), top.ravel()


_DEALT = ["row", "n", "vector", "shard"]


def _assign(centre, dims: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            row, shard = _nearest(_matrix(b.column(2), dims), centre.value, overlap)
            yield pa.RecordBatch.from_arrays([*(col.take(pa.array(row)) for col in b.columns), pa.array(shard.astype(np.int64))], _DEALT)

    return run


def _own_centres(dims: int, shard_size: int):
    """A sample of a shard -> its centres, as rows."""

    def run(t: pa.Table) -> pa.Table:
        x = _matrix(t["vector"], dims)
        c = centres(x, min(len(x), max(4, min(math.ceil(2 * t["many"][0].as_py() / shard_size), len(x) // 8))))
        return pa.table({"shard": pa.array([t["shard"][0].as_py()] * len(c), pa.int64()), "centre": pa.array(list(c), pa.list_(pa.float64()))})

    return run


def _reassign(dims: int):
    """(part of a shard, its centres) -> the same nodes in two of the shards it is split into."""

    def run(t: pa.Table, c: pa.Table) -> pa.Table:
        kinds = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("vector", pa.list_(pa.float64())), ("shard", pa.int64())])
        if not t.num_rows:
            return kinds.empty_table()
        row, of = _nearest(_matrix(t["vector"], dims), _matrix(c["centre"], dims), 2)
        name = mix(np.uint64(t["shard"][0].as_py() & (1 << 63) - 1) + (of + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
        new = t.select(_DEALT[:3]).take(pa.array(row)).append_column("shard", pa.array(name.astype(np.int64)))
        return new.cast(kinds)

    return run


def _split(dealt: DataFrame, dims: int, shard_size: int, sample: int) -> DataFrame:
    """Shards of more than twice ``shard_size`` nodes become several, until there are none, or
    none that gets smaller."""
    last = None
    while True:
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("many"))
        over = stage(sizes.where(F.col("many") > 2 * shard_size), "overfull")
        most = over.agg(F.max("many")).first()[0]
        if most is None or last is not None and most > 0.9 * last:
            return dealt
        last = most
        large = dealt.join(unless_large(over), "shard")
        some = large.where(F.pmod(F.xxhash64("row", "shard", F.lit(6)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("many"))
        own = stage(some.groupBy("shard").applyInArrow(_own_centres(dims, shard_size), "shard long, centre array<double>"), "centres")
        parts = F.ceil(F.col("many") / sample).cast("int")  # a task holds a part of a shard
        part = large.withColumn("part", F.pmod(F.xxhash64("row", F.lit(8)), parts).cast("int")).select(*_DEALT, "part")
        copied = own.join(unless_large(over), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("shard", "part", "centre")
        again = part.groupBy("shard", "part").cogroup(copied.groupBy("shard", "part")).applyInArrow(_reassign(dims), "row long, n long, vector array<double>, shard long")
        rest = dealt.join(unless_large(over), "shard", "left_anti").select(_DEALT)
        dealt = stage(rest.unionByName(again.distinct()), "dealt", [dealt, over, own])


def _graph(dims: int, alpha: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        rep = t["row"].to_numpy()
        edges = build(_matrix(t["vector"], dims), alpha, t["shard"][0].as_py())
        ends = np.searchsorted(edges[:, 0], np.arange(len(rep) + 1)).astype(np.int32)
        return pa.table({"a": rep, "b": pa.ListArray.from_arrays(pa.array(ends), pa.array(rep[edges[:, 1]]))})

    return run


def _links(dims: int, radius: float, beam: int):
    """(nodes of a shard, lists that end in it) -> counts and a spanning forest."""

    def run(t: pa.Table, lists: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        rep, n, x = t["row"].to_numpy(), t["n"].to_numpy(), _matrix(t["vector"], dims)
        shard = t["shard"][0].as_py()
        to = lists["b"].combine_chunks()
        edges = np.column_stack([np.repeat(lists["a"].to_numpy(), np.diff(to.offsets.to_numpy())), to.flatten().to_numpy()])
        at = np.searchsorted(rep, edges)
        inside = (rep[np.minimum(at, len(rep) - 1)] == edges).all(1)
        pairs = search(x, np.unique(at[inside], axis=0).reshape(-1, 2), radius, beam)
        forest = stars(rep[pairs])
        lists_of = t["shards"].combine_chunks()
        many = np.diff(lists_of.offsets.to_numpy())
        mine = np.full((len(t), many.max()), -1)
        mine[np.arange(many.max()) < many[:, None]] = lists_of.flatten().to_numpy()
        first = [np.empty(0, np.int64)]
        for part in np.array_split(pairs, max(1, len(pairs) // 100_000)):
            a, b = mine[part[:, 0]], mine[part[:, 1]]
            shared = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(2)
            first.append(a[np.arange(len(part)), shared.argmax(1)])
        pairs = pairs[np.concatenate(first) == shard]
        count = np.bincount(pairs[:, 0], n[pairs[:, 1]], len(rep)) + np.bincount(pairs[:, 1], n[pairs[:, 0]], len(rep))
        some = np.flatnonzero(count)
        size = len(some) + len(forest)
        return pa.table(
            {
                "a": np.concatenate([rep[some], forest[:, 0]]),
                "b": pa.array([None] * len(some) + forest[:, 1].tolist(), pa.int64()),
                "links": pa.array(np.concatenate([count[some], np.zeros(size - len(some))]).astype(np.int64)),
            }
        )

    return run


def _audited(queries, ids: np.ndarray, dims: int, radius: float):
    """For each queried node the weight of its links, compared with all nodes in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        total = np.zeros(len(ids), np.int64)
        for b in slices(batches, 4096):
            near = (q @ _matrix(b.column(2), dims).T >= radius) & (ids[:, None] != b.column(0).to_numpy()[None])
            total += near @ b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["row", "true_links"])

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", radius: float = 0.9, shard_size: int = 1500, overlap: int = 4, beam: int = 48, alpha: float = 1.2,
    max_sample: int = 20_000, audit_sample: int = 500, least_recall: float = 0.95,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept, recall (as audited).

    n_links: other rows within ``radius``. component_id: the least id that links reach.
    kept: whether that is the row's own. ``max_sample`` bounds the rows that centres are
    fitted on, ``audit_sample`` those that recall is measured with, both in expectation.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with
    nothing. Vectors of unequal length are compared as if zeros were added to the shorter.
    Rows that repeat a vector link with each other; rows that repeat an id are rows like any
    other. Null ids link, but name no component: component_id is null where no other id is in
    reach. Ties in cosine need no order. ``recall`` is null where no audited vector has a
    link. Other columns are ignored. An empty table gives an empty result.
    """
    require(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    value = F.transform(F.col(vector_col), lambda v: v.cast("double") + F.lit(0.0))
    usable = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(value, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, value).alias("vector"))
    key = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]
    nodes = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("row"), "rep", "n", "vector", *key), "nodes")
    many, dims = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
    found, recall = None, None
    if many:
        hashed = lambda seed, most: F.pmod(F.xxhash64("h1", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / many))
        matrix_of = lambda df: _matrix(pa.array(df.toPandas().sort_values("row")["vector"].map(list).tolist(), pa.list_(pa.float64())), dims)
        sample = matrix_of(nodes.where(hashed(3, max_sample)).select("row", "vector"))
        audit = nodes.where(hashed(4, audit_sample)).select("row", "vector")
        ids = np.sort(audit.select("row").toPandas()["row"].to_numpy())
        truth = None
        if len(ids):
            queries = spark.sparkContext.broadcast(matrix_of(audit))  # bounded by audit_sample
            truth = nodes.select("row", "n", "vector").mapInArrow(_audited(queries, ids, dims, radius), "row long, true_links long").groupBy("row").agg(F.sum("true_links").alias("true_links"))
            truth = stage(truth.where("true_links > 0"), "audit")
        k = max(1, min(math.ceil(many * overlap / shard_size), len(sample) // 8))
        centre = spark.sparkContext.broadcast(centres(sample, k) if len(sample) else np.ones((1, dims)))  # bounded by max_sample
        while True:
            dealt = stage(nodes.select("row", "n", "vector").mapInArrow(_assign(centre, dims, overlap), "row long, n long, vector array<double>, shard long"), "dealt")
            split = _split(dealt, dims, shard_size, 2000)
            shards = split.groupBy("row").agg(F.sort_array(F.collect_set("shard")).alias("shards"))  # of one node
            dealt = stage(split.join(shards, "row"), "dealt", [split])
            lists = dealt.groupBy("shard").applyInArrow(_graph(dims, alpha), "a long, b array<long>")
            edges = stage(lists.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("b"))).alias("b")), "graph")  # of a node's shards
            united = dealt.select(F.col("row").alias("a"), F.col("shard").alias("of")).join(edges, "a")
            both = dealt.groupBy("shard").cogroup(united.groupBy("of")).applyInArrow(_links(dims, radius, beam), "a long, b long, links long")
            found = stage(both, "links", [dealt, edges])
            if truth is None:
                break
            got = found.groupBy("a").agg(F.sum("links").alias("links"))
            recall = truth.join(got, truth["row"] == got["a"], "left").agg(F.avg(F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("true_links")))).first()[0]
            if recall is None or recall >= least_recall or overlap >= len(centre.value) and shard_size >= many:
                break
            overlap, beam, shard_size = min(2 * overlap, len(centre.value)), 2 * beam, 4 * shard_size
            release(found)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    counts = found.groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "row")
    joined = nodes.select("row", "rep", "n", "h1", "h2").join(counts, "row", "left").join(groups, "row", "left")
    joined = stage(joined.select("h1", "h2", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "row").alias("component")), "joined")
    least = stage(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    classes = stage(joined.join(least, "component").select("h1", "h2", "n_links", "component_id", F.lit(True).alias("known")), "classes", [joined, least])
    out = rows.select("id", *[F.when(F.col("vector").isNotNull(), x).alias(n) for x, n in zip(key, ("h1", "h2"))]).join(classes, ["h1", "h2"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"), F.lit(recall).cast("double").alias("recall"),
    )
