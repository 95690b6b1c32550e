"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def stars(pairs: np.ndarray) -> np.ndarray:
    """Links (n, 2) -> an equivalent forest: each id linked with its component's least id."""
    if not len(pairs):
        return np.empty((0, 2), np.int64)
    ids, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    root = np.arange(len(ids))
    while True:  # hook the larger root under the smaller, then halve the paths
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        while not np.array_equal(up := root[root], root):
            root = up
    own = root != np.arange(len(ids))
    return np.column_stack([ids[own], ids[root[own]]])


_HELD = 1 << 19  # links that a task holds


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, fresh = np.empty((0, 2), np.int64), []
    for x in batches:
        fresh.append(x[["a", "b"]].to_numpy(np.int64))
        if sum(map(len, fresh)) >= max(_HELD >> 3, len(held)):
            held, fresh = stars(np.concatenate([held, *fresh])), []
            if len(held) >= _HELD:
                yield pd.DataFrame(held, columns=["a", "b"])
                held = held[:0]
    yield pd.DataFrame(stars(np.concatenate([held, *fresh])), columns=["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (longs). Returns (id, component): a row for each id that has a link,
    component being the least id that links reach.

    Links are first contracted to stars where they lie, in few tasks. Large-star and
    small-star rounds follow until nothing changes: log^2 of the longest path at most,
    a few in practice. Minima merge before the shuffle and joins may split a hot id.
    Each round is a written table. Links from an id to itself are allowed. Nulls are not.
    """
    links = stage(links.select("a", "b"), "links")
    few = links.coalesce(max(1, math.ceil(links.count() / _HELD)))  # no shuffle: a task reads several parts
    star = stage(few.mapInPandas(_contract, "a long, b long").distinct(), "stars", [links])  # a > b
    state = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")  # written, so that the join may split a hub
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large", [star, least])
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        star = stage(small, "small", [large, least])
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
