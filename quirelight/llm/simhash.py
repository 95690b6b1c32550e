"""Near-duplicates by SimHash fingerprints, with pivot distance tables.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of the
text's word shingles. Rows of equal fingerprints are one class. Classes within
``radius`` bits link, and components of links are the groups of near-duplicates.

Candidates: the 64 bits are cut into ``blocks`` pieces. Two fingerprints that differ in
at most ``radius`` bits agree on at least ``blocks - radius`` whole pieces, so classes
are dealt by each choice of that many pieces, and no link is missed. Within a bucket
pivot tables decide: the Hamming distances of a class to 24 fixed reference fingerprints
are computed once and travel with it, a pair whose coordinates differ by more than
``radius`` anywhere cannot be close (triangle inequality) and is discarded, and what
survives is verified on the bits. A large bucket is kept in order of the first coordinate,
so that a member looks at those within ``radius`` of its own only. A pivot table alone would
have to look at all pairs, hence the buckets before it.

Buckets of many members are searched from member to member: a member once reached is
compared with members not yet reached only. A bucket yields a spanning forest of its
links, never all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, slices, stage
from .components import connected_components, stars

SEED = 42
_PIVOTS = np.random.default_rng(64).integers(0, 2**64, 24, dtype=np.uint64)
_SMALL = 64  # members up to which a bucket's pairs are taken all at once


def fingerprint(data: bytes, words: int = 4) -> int:
    """The SimHash of a UTF-8 text; A-Z lower-cased, words split at white space."""
    found = data.lower().split()  # bytes: ASCII only, at \\x20 and \\x09-\\x0D
    n = len(found)
    if not n:
        return 0
    line = b" ".join(found)
    if n < words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    votes, shingles = np.zeros(64, np.int64), n - words + 1
    for at in range(0, shingles, 1 << 16):
        upto = min(at + (1 << 16), shingles)
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[at:upto].tolist(), ends[at + words - 1 : upto + words - 1].tolist())])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > shingles).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            got = [fingerprint(t or b"", words) for t in x.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _distances() -> list[Column]:
    """Hamming distances of ``fp`` to the pivots, eight to a long."""
    each = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p)))).cast("long") for p in _PIVOTS.view(np.int64)]
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(each[8 * k + i], 8 * i) for i in range(8)]).alias(f"d{k}") for k in range(len(each) // 8)]


def _edges_small(at: np.ndarray, run: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links among the rows ``at``, which are in order of their bucket ``run``."""
    table = table[at]
    out, f, r = [], fp[at], run[at]
    for step in range(1, _SMALL):
        pair = np.flatnonzero(r[step:] == r[:-step])
        if not len(pair):
            break
        for p in range(table.shape[1]):
            pair = pair[np.abs(table[pair, p] - table[pair + step, p]) <= radius]
        pair = pair[np.bitwise_count(f[pair] ^ f[pair + step]) <= radius]
        out.append(np.column_stack([at[pair], at[pair + step]]))
    return out


def _edges_large(at: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest of the links among the rows ``at`` of one bucket."""
    order = np.argsort(table[at, 0], kind="stable")  # a member's partners lie within ``radius`` of its first distance
    at = at[order]
    first, table, fp = table[at, 0], table[at], fp[at]
    reached, out, start, todo = np.zeros(len(at), bool), [], 0, []
    while True:
        if not todo:
            while start < len(at) and reached[start]:
                start += 1
            if start == len(at):
                break
            reached[start] = True
            todo.append(start)
        i = todo.pop()
        low, high = np.searchsorted(first, [first[i] - radius, first[i] + radius + 1])
        near = low + np.flatnonzero(~reached[low:high])
        for p in range(1, table.shape[1]):
            near = near[np.abs(table[near, p] - table[i, p]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= radius]
        if len(near):
            reached[near] = True
            out.append(np.column_stack([np.full(len(near), at[i]), at[near]]))
            todo += near.tolist()
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _links_of(bucket: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Rows in order of their bucket -> links between fingerprints, as signed longs.
    table: their distances to the pivots."""
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[start, len(bucket)])
    run = np.repeat(np.arange(len(start)), size)
    each = np.repeat(size, size)
    out = _edges_small(np.flatnonzero((each > 1) & (each <= _SMALL)), run, fp, table, radius)
    out += [_edges_large(np.arange(a, a + n), fp, table, radius) for a, n in zip(start[size > _SMALL], size[size > _SMALL])]
    return stars(fp.view(np.int64)[np.concatenate(out)]) if out else np.empty((0, 2), np.int64)


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def yielded(x):
            table = np.ascontiguousarray(x[:, 2:]).view(np.uint8).astype(np.int8)
            got = _links_of(x[:, 0], x[:, 1].copy().view(np.uint64), table, radius)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], ["a", "b"])

        held, rows, goal = [], 0, 1 << 16
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.column_stack([c.to_numpy() for c in b.columns]))
            rows += b.num_rows
            if rows >= goal:
                x = np.concatenate(held)
                cut = np.searchsorted(x[:, 0], x[-1, 0])  # the last bucket may go on
                if cut:
                    yield yielded(x[:cut])
                held, rows = [x[cut:]], len(x) - cut
                goal = max(1 << 16, 2 * rows)
        if rows:
            yield yielded(np.concatenate(held))

    return run


def _bucket_keys(blocks: int, radius: int):
    """An array column: for each choice of blocks - radius pieces, their bits and which choice it is."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for k, choice in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def fingerprint_links(classes: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b): of a written table of different fingerprints ``fp``, links whose components are those of all
    pairs within ``radius`` bits. Distances to the pivots are taken from it, or made if it hasn't them."""
    if blocks is None:
        bits = math.log2(max(2, classes.count()))
        blocks = next(b for b in range(radius + 2, 65) if 64 * (b - radius) / b >= min(bits, 40))
    classes = classes if "d0" in classes.columns else classes.select("fp", *_distances())
    tables = [c for c in classes.columns if c not in ("fp", "rep")]
    dealt = classes.select(F.explode(_bucket_keys(blocks, radius)).alias("bucket"), "fp", *tables)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id: the least id reachable by links, its own included. Rows of equal
    fingerprints are linked. ``blocks``: pieces to cut fingerprints into; by default the
    fewest whose bucket keys have as many bits as the number of classes has.

    Null and empty texts have fingerprint zero and are linked like any other; very long ones
    are hashed in parts. Rows with null ids link like any other; component_id is null where
    no other id is in reach. Repeated ids and rows are allowed. Other
    columns are ignored. An empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    fps = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("id").alias("rep")).select("fp", "rep", *_distances()), "classes")
    found = fingerprint_links(classes, radius, blocks)
    groups = connected_components(found).withColumnRenamed("id", "fp")  # of fingerprints, so that null ids are in them too
    named = stage(classes.select("fp", "rep").join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = stage(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = named.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
