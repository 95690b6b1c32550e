"""Packing documents into training sequences: conflict-constrained best fit.

A sequence (bin) holds ``capacity`` bytes. A text takes its UTF-8 bytes plus one
separator; a longer one is cut into pieces of ``capacity`` and a rest. Pieces are
placed from the largest to the smallest. Bins are ordered by what is left in them, and
each carries a bitmap of the sources and one of the duplicate clusters it holds. A
piece goes to the tightest bin that has room and neither its source nor its cluster:
the search takes the successor of the piece's size among the residuals, and goes on to
the next bin while bitmaps conflict. Only if no open bin is compatible a new one opens.

Pieces are dealt to groups of about ``group_size`` by a hash of row and piece, so that a
source, cluster or id with a third of all rows is spread like the rest, and each group is
packed by itself. No text is moved: ids, sizes and two hashes are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, require, stage, text_or_empty


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Items in the order of placing -> (bin of each, offset in its bin). A source or
    cluster of -1 conflicts with nothing. Sizes are 0 to ``capacity``."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual
    some = 0  # bit r: a bin has residual r
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    placed, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        rest, left, chosen = some >> size, size, -1
        while rest:
            step = (rest & -rest).bit_length() - 1
            left += step
            for k, b in enumerate(open_at[left]):
                if not (source_bits[b] & s or cluster_bits[b] & c):
                    chosen = b
                    break
            if chosen >= 0:
                del open_at[left][k]
                if not open_at[left]:
                    some ^= 1 << left
                break
            rest >>= step + 1
            left += 1
        if chosen < 0:
            chosen, left = len(source_bits), capacity
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[chosen] |= s
        cluster_bits[chosen] |= c
        placed.append(chosen)
        offsets.append(capacity - left)
        open_at[left - size].append(chosen)
        some |= 1 << (left - size)
    return placed, offsets


def _numbered(column: pa.ChunkedArray, shared_only: bool) -> list[int]:
    """Small numbers for values; -1 for null, and for what occurs once if ``shared_only``."""
    codes = column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if shared_only and len(codes):
        many = np.bincount(codes[codes >= 0], minlength=1) > 1
        number = np.where(many, np.cumsum(many) - 1, -1)
        codes = np.where(codes >= 0, number[codes], -1)
    return codes.tolist()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = 8192, group_size: int = 4096) -> DataFrame:
    """One row per piece: id, piece, start, n_bytes, bin, position, offset.

    start, n_bytes: which bytes of text and separator the piece is. bin: a number that is
    unique over all groups. position, offset: the piece's place and first byte in its bin.
    ``cluster_col``: what equal values of tell duplicates; by default texts that are equal
    after lower-casing A-Z.

    Every row is packed. Null and empty texts are a piece of one byte and, like null
    sources and clusters, conflict with nothing. Ties in size are placed in order of id and piece.
    Repeated rows conflict by source and cluster like others. An empty table gives an
    empty result. Other columns are ignored.
    """
    require(docs, id_col, text_col, source_col, *([cluster_col] if cluster_col else []))
    text = text_or_empty(text_col)
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(lower_ascii(text))
    absent = F.col(cluster_col).isNull() if cluster_col else F.lit(False)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.when(F.col(source_col).isNotNull(), F.xxhash64(source_col)).alias("source"),
        F.when(~absent & (F.length(text) > 0), cluster).alias("cluster"),
    )
    pieces = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {capacity} as int)"))))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * capacity).withColumn("n", F.least(F.lit(capacity), F.col("size") - F.col("start")).cast("int")).drop("size")
    pieces = stage(pieces, "pieces")
    groups = max(1, math.ceil(pieces.count() / group_size))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "descending"), ("id", "ascending"), ("piece", "ascending")])
        sizes = t["n"].to_pylist()
        bins, offsets = best_fit(sizes, _numbered(t["source"], False), _numbered(t["cluster"], True), capacity)
        met: dict[int, int] = {}
        position = []
        for b in bins:
            position.append(met.get(b, 0))
            met[b] = position[-1] + 1
        number = (t["grp"].to_numpy() << 32) + np.array(bins, np.int64)
        return pa.table({"id": t["id"], "piece": t["piece"], "start": t["start"], "n_bytes": t["n"], "bin": number, "position": pa.array(position, pa.int32()), "offset": pa.array(offsets, pa.int32())})

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups))).drop("row")
    packed = dealt.groupBy("grp").applyInArrow(run, f"id {kind}, piece int, start long, n_bytes int, bin long, position int, offset int")
    return packed.withColumnRenamed("id", id_col)
