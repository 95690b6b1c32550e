"""Shards of near equal bytes, from sampled splitters.

Keys (a 64-bit hash of the text) are drawn with a weight that is the row's size.
Quantiles of the sample are the splitters: they range-partition the rows into many
more cells than shards. The bytes of every cell are then counted exactly, and a cell
whose bytes are over twice its share is subdivided: by a hash of the key, so that equal
texts stay together, and a single key that is larger than a cell by itself leaves it.

Such large groups are placed first, from the largest on, to and fro over the shards, each
as a whole; only a group larger than a shard is cut, by row. The other cells follow one
after another: shards are runs of them, cut between groups of equal keys where the exact
running total passes what room the large groups have left in a shard.

Only DataFrame operations run here. Texts are read once and never shuffled. What is
broadcast or brought together is one row a cell or large group, and their number is
bounded by ``shards * cells_per_shard``, not by the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, stage, text_or_empty

_U = 1 << 20  # steps of the uniform number that rounds a row's expected draws
_CELL = ["range", "lump", "own", "part"]


def _splitters(rows: DataFrame, cells: int, samples_per_cell: int, total: int) -> list[int]:
    """Distinct keys at the quantiles of a size-weighted sample; at most cells - 1."""
    rate = cells * samples_per_cell / max(1, total)
    uniform = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(_U)) / F.lit(float(_U))
    drawn = rows.select("key", F.floor(F.col("size") * F.lit(rate) + uniform).cast("int").alias("draws")).where("draws > 0")
    drawn = drawn.select("key", F.explode(F.sequence(F.lit(1), "draws")))
    at = [i / cells for i in range(1, cells)]
    found = drawn.agg(F.percentile_approx("key", at, 100_000).alias("q")).first()["q"]  # cells - 1 numbers
    return sorted(set(found or []))


def _range_of(splitters: list, value: Column) -> Column:
    """How many splitters are <= value, by binary search inside the plan."""
    if not splitters:
        return F.lit(0)
    n, steps = len(splitters), [1 << i for i in range(len(splitters).bit_length() - 1, -1, -1)]
    at = F.array(*map(F.lit, splitters))
    step = lambda pos, s: F.when((pos + s <= n) & (F.element_at(at, F.least(pos + s, F.lit(n))) <= value), pos + s).otherwise(pos)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _cuts(loads: list[int], rest: int) -> list[float]:
    """Where runs of ``rest`` bytes end, so that with ``loads`` the shards come out as even as they can."""
    level, below = 0.0, 0
    for k, load in enumerate(sorted(loads), 1):  # the level of the k emptiest, if only they are filled up
        below += load
        if k == 1 or load < level:
            level = (rest + below) / k
    upto, out = 0.0, []
    for load in loads[:-1]:
        upto += max(0.0, level - load)
        out.append(upto)
    return out


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, cells_per_shard: int = 128, samples_per_cell: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 1. law is ``bytes``: sizes of shards
    differ by about a cell (1 / ``cells_per_shard`` of a shard), or by more where groups of
    equal texts leave no other way. Equal texts share a shard unless together they are
    larger than one. slot: the row's place in its shard, 0 and on without gaps.
    grown_shard is null under this law.

    Null text: size 1, CRC 0. Null and repeated ids, and rows that repeat, keep their own
    slots; ties in key are ordered by row. A very long text is one row, whatever its size.
    With fewer rows than shards some shards are empty. Other columns are ignored. An empty
    table gives an empty result.
    """
    require(docs, id_col, text_col)
    text = text_or_empty(text_col)
    sized = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.xxhash64(text).alias("key"))
    rows = stage(sized.withColumn("row", F.monotonically_increasing_id()), "rows")
    cells = shards * cells_per_shard
    total = rows.agg(F.sum("size")).first()[0] or 0
    share, target = max(1.0, total / cells), total / shards
    ranged = rows.withColumn("range", _range_of(_splitters(rows, cells, samples_per_cell, total), F.col("key")).cast("int"))
    full = stage(ranged.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * share).coalesce(1), "full")  # at most cells / 2 rows
    heavy = ranged.join(F.broadcast(full.select("range")), "range").groupBy("range", "key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share)
    heavy = stage(heavy.coalesce(1), "heavy")  # at most `cells` rows
    turn = F.row_number().over(Window.orderBy(F.desc("bytes"), "key")) - 1
    there = F.pmod(turn, F.lit(2 * shards))
    whole = heavy.where(F.col("bytes") <= target).select("range", "key", "bytes", F.when(there < shards, there).otherwise(2 * shards - 1 - there).alias("fixed"))
    cut = heavy.where(F.col("bytes") > target).select("range", "key", "bytes", F.lit(None).cast("int").alias("fixed"))
    heavy = stage(whole.unionByName(cut).withColumn("pieces", F.ceil(F.col("bytes") / share).cast("int")).coalesce(1), "placed")
    loads = {r["fixed"]: r["b"] for r in heavy.where("fixed IS NOT NULL").groupBy("fixed").agg(F.sum("bytes").alias("b")).collect()}  # a row a shard
    loads = [loads.get(s, 0) for s in range(shards)]
    taken = heavy.groupBy("range").agg(F.sum("bytes").alias("taken"))
    left = F.col("bytes") - F.coalesce("taken", F.lit(0))
    parts = stage(full.join(F.broadcast(taken), "range", "left").select("range", F.when(left > 2 * share, F.ceil(left / share)).otherwise(1).cast("int").alias("parts")).coalesce(1), "ranges")

    dealt = ranged.join(F.broadcast(parts), "range", "left").join(F.broadcast(heavy.drop("bytes")), ["range", "key"], "left")
    lump = F.when(F.col("pieces").isNull(), 0).when(F.col("fixed").isNull(), 1).otherwise(2)
    by = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("key", F.lit(13)), F.coalesce("parts", F.lit(1)))).otherwise(F.pmod(F.xxhash64("row", F.lit(11)), F.col("pieces")))
    dealt = dealt.select("id", "size", "crc", "key", "row", "range", "fixed", lump.alias("lump"), F.when(F.col("pieces").isNull(), F.lit(0).cast("long")).otherwise(F.col("key")).alias("own"), by.cast("int").alias("part"))
    dealt = stage(dealt, "dealt", [full, parts])

    before = Window.orderBy(*_CELL).rowsBetween(Window.unboundedPreceding, -1)
    cell = dealt.where("lump < 2").groupBy(*_CELL).agg(F.sum("size").alias("bytes"))  # at most 4 * `cells` rows
    cell = stage(cell.select(*_CELL, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before")).coalesce(1), "cells")
    upto = F.sum("size").over(Window.partitionBy(*_CELL).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum("size").over(Window.partitionBy(*_CELL, "key"))
    middle = F.col("before") + upto - same / 2
    found = F.least(F.lit(shards - 1), _range_of(_cuts(loads, total - sum(loads)), middle)).cast("int")
    ran = dealt.where("lump < 2").join(F.broadcast(cell), _CELL).withColumn("shard", found).drop("before", "fixed")
    placed = stage(ran.unionByName(dealt.where("lump = 2").withColumnRenamed("fixed", "shard")), "placed", [rows])

    ahead = Window.partitionBy("shard").orderBy(*_CELL).rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy(*_CELL, "shard").agg(F.count("*").alias("n"))  # at most 5 * `cells` + `shards` rows
    offset = stage(offset.select(*_CELL, "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")).coalesce(1), "offsets", [dealt, cell, heavy])
    place = F.row_number().over(Window.partitionBy(*_CELL, "shard").orderBy("key", "row"))
    return (
        placed.withColumn("place", place)
        .join(F.broadcast(offset), [*_CELL, "shard"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
