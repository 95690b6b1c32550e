"""Exact duplicates through an extendible-hash index kept on shared files.

Texts are equal when they are identical after lower-casing A-Z. Every text has a
64-bit key. The directory has 2^g slots, one for each value of the key's first g
bits; a slot that holds more than the bucket's capacity of distinct keys makes the
directory double (g + 1), and only the overfull bucket splits, so that each bucket
has a local depth of its own. Buckets are dealt to owner tasks by ranges of slots.

Rows are sent to the owner that the directory names. Within its buckets an owner chains
the texts whose keys collide, comparing their bytes, and writes the chains' entries to its
own folder of the index. Every row then looks its entry up there.

Only rows whose key occurs again travel with their text: a key that occurs once has one
text, and its entry needs no comparison. Rows of a very common key are first merged by
salted sub-owners, so that a text with a third of all rows reaches its owner as a few
rows. The capacity of buckets grows with the number of keys, so that the directory has a
bounded size. Only DataFrame operations run here.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, release, require, stage, text_or_empty, unless_large

_SLOTS = 1 << 18  # that the directory starts with at most
_HOT, _SALTS = 1000, 64  # rows of a key from which it is merged before, and by how many


def _slot(depth: int):
    """The first ``depth`` bits of the key."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, bucket_capacity: int, owners: int) -> tuple[DataFrame, int]:
    """keys: a row for each distinct ``key``. Returns (directory, global depth); the
    directory has a row for each slot: slot, bucket (first slot), local_depth, owner."""
    depth = max(0, math.ceil(math.log2(max(1, keys.count()) / bucket_capacity)))
    still, closed = keys, []
    while True:
        counts = still.groupBy(_slot(depth).alias("prefix")).agg(F.count("*").alias("n_keys"))
        counts = stage(counts, "buckets")
        closed.append(counts.where(F.col("n_keys") <= bucket_capacity).select("prefix", "n_keys", F.lit(depth).alias("local_depth")))
        overfull = counts.where(F.col("n_keys") > bucket_capacity).select("prefix")
        if depth >= 62 or overfull.isEmpty():
            break
        still = still.withColumn("prefix", _slot(depth)).join(overfull, "prefix", "left_semi").drop("prefix")
        depth += 1
    buckets = closed[0]
    for more in closed[1:]:
        buckets = buckets.unionByName(more)
    width = F.expr(f"shiftleft(1L, {depth} - local_depth)")
    first = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    directory = (
        buckets.withColumn("bucket", first)
        .withColumn("slot", F.explode(F.sequence(F.col("bucket"), F.col("bucket") + width - 1)))
        .select("slot", "bucket", "local_depth", F.floor(F.col("bucket") * F.lit(owners / 2.0**depth)).cast("int").alias("owner"))
    )
    return stage(directory, "directory"), depth


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, bucket_capacity: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Of equal texts the row with the largest id stays. chain: the text's place among
    texts whose keys collide (1 but for such collisions).

    Null text counts as empty; all empty texts are one group. Very long texts are compared
    whole, and travel only if their key occurs again. Rows that repeat an id and text each
    count in group_size and are all marked kept, unless ``row_col`` names a column with a
    long that no two rows share: then one row of a group is kept, on ties that with the
    largest of these numbers, and the column is returned too. A null id never stays if the
    group has another. Other columns of ``docs`` are ignored, whatever their names. An empty
    table gives an empty result.
    """
    require(docs, id_col, text_col, *([row_col] if row_col else []))
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), row.alias("row"), lower_ascii(text_or_empty(text_col)).alias("norm"))
    best = F.struct("id", "row") if row_col else F.col("id")  # null is the least
    keyed = stage(rows.select("id", "row", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha")), "keyed")
    keys = stage(keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("id"), F.max("row").alias("row"), F.max("sha").alias("sha")), "keys")
    capacity = max(bucket_capacity, math.ceil(keys.count() / _SLOTS))
    directory, depth = build_directory(keys.select("key"), capacity, owners)
    placed = lambda df: df.withColumn("slot", _slot(depth)).join(F.broadcast(directory.select("slot", "bucket", "owner")), "slot").drop("slot")  # noqa: E731  about 2 * _SLOTS rows at most

    again = stage(keys.where("n > 1").select("key", "n"), "again")
    texts = rows.withColumn("key", F.xxhash64("norm")).join(unless_large(again), "key")
    cold = texts.where(F.col("n") <= _HOT).select("key", "norm", best.alias("best"), F.lit(1).cast("long").alias("size"))
    salt = F.pmod(F.xxhash64("id", "row"), F.lit(_SALTS))
    hot = texts.where(F.col("n") > _HOT).groupBy("key", "norm", salt.alias("salt")).agg(F.max(best).alias("best"), F.count("*").alias("size")).drop("salt")
    chained = Window.partitionBy("owner", "bucket", "key").orderBy("sha")
    compared = (
        placed(cold.unionByName(hot))
        .repartition(owners, "owner")
        .groupBy("owner", "bucket", "key", "norm")  # by the owner: each text of a key against its chain
        .agg(F.max("best").alias("best"), F.sum("size").alias("group_size"))
        .select("owner", "bucket", "key", F.sha2("norm", 256).alias("sha"), "best", "group_size")
        .withColumn("chain", F.row_number().over(chained))
    )
    alone = placed(keys.where("n = 1")).select("owner", "bucket", "key", "sha", best.alias("best"), F.lit(1).cast("long").alias("group_size"), F.lit(1).alias("chain"))
    index = stage(compared.unionByName(alone), "index", by="owner")
    release(again, keys)
    found = placed(keyed).join(index, ["owner", "bucket", "key", "sha"], "left")
    out = [F.col("best.id" if row_col else "best").alias("keep_id"), "group_size", best.eqNullSafe(F.col("best")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain"]
    return found.select(F.col("id").alias(id_col), *([F.col("row").alias(row_col)] if row_col else []), *out)
