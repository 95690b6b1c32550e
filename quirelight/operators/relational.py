"""The relational kernels of document optimisation, on any tables of the right shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def canonical(objects: DataFrame, payload: list[str], order: str, within: list[str] | None = None) -> DataFrame:
    """Rows plus ``canon``: the first row's ``order`` among equal payloads. Texts and binaries
    are compared by length and SHA-256, and don't travel for it: groups merge with a partial
    minimum, and rows meet their group's by its key, which joins may split if it is common."""
    kinds = dict(objects.dtypes)
    digest = lambda k: F.struct(F.octet_length(k), F.sha2(F.col(k).cast("binary"), 256)) if kinds[k] in ("string", "binary") else F.col(k)
    parts = [digest(k) for k in [*(within or []), *payload]]
    keyed = objects.withColumn("_key", F.sha2(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])), 256))
    firsts = keyed.groupBy("_key").agg(F.min(order).alias("canon"))
    return keyed.join(firsts, "_key", "left").drop("_key").select(*objects.columns, "canon")


def rewrite(references: DataFrame, canon: DataFrame, target: str, key: str, to: str) -> DataFrame:
    """References whose target has a canonical object point to it."""
    c = canon.select(F.col(key).alias("_key"), F.col(to).alias("_to"))
    return references.join(c, references[target] == F.col("_key"), "left").withColumn(target, F.coalesce("_to", target)).drop("_key", "_to")


def closure(seeds: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All that seeds reach: seeds (keys, node), edges (keys, src, dst). Cycles are fine."""
    keys = keys or []
    cols = [*keys, "node"]
    seen = frontier = stage(seeds.select(cols).distinct(), "seen")
    while True:
        step = frontier.join(edges.withColumnRenamed("src", "node"), cols).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = stage(step.join(seen, cols, "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = stage(seen.unionByName(frontier), "seen")
    return seen


def inherited(nodes: DataFrame, id_col: str, parent: str, value: str) -> DataFrame:
    """Adds ``inherited``: a node's value or its nearest ancestor's that has one. Each round
    doubles the ancestors looked at; what is open once they could be all nodes is on a cycle."""
    own = nodes.select(F.col(id_col).alias("_id"), F.col(parent).alias("_up"), F.col(value).alias("_value"))
    state = stage(own.withColumnRenamed("_id", id_col), "inherited")
    for _ in range(state.count().bit_length()):
        todo = state.where("_value IS NULL AND _up IS NOT NULL")
        if todo.isEmpty():
            break
        up = state.select(F.col(id_col).alias("_k"), F.col("_up").alias("_up2"), F.col("_value").alias("_value2"))
        stepped = state.join(up, (state["_up"] == up["_k"]) & state["_value"].isNull(), "left")
        moved = F.col("_value").isNull() & F.col("_up").isNotNull()
        state = stage(stepped.select(id_col, F.when(moved, F.col("_up2")).otherwise(F.col("_up")).alias("_up"), F.coalesce("_value", "_value2").alias("_value")), "inherited")
    return nodes.join(state.select(id_col, F.col("_value").alias("inherited")), id_col)


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last value so far that isn't null, in order: a state such as the current font."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """Runs of consecutive numbers: (by, start, length). Repeats of a number count once."""
    w = Window.partitionBy(*by).orderBy(n)
    keyed = df.select(*by, n).distinct().withColumn("_run", F.col(n) - F.row_number().over(w))
    return keyed.groupBy(*by, "_run").agg(F.min(n).alias("start"), F.count("*").alias("length")).drop("_run")


def differences(df: DataFrame, by: list[str], order: str, number: Column, is_name: Column) -> DataFrame:
    """The counter of a /Differences array: a number sets it, each name takes the next."""
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_set", F.last(number, ignorenulls=True).over(upto)).withColumn("_run", F.count(number).over(upto))
    place = F.sum(is_name.cast("int")).over(Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("code", F.coalesce("_set", F.lit(0)) + place - 1).where(is_name).drop("_set", "_run")


def unused(resources: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    return resources.join(used.select(on).distinct(), on, "left_anti")


def vetoed(members: DataFrame, group: str, bad: Column) -> DataFrame:
    """Members of groups of which no member is bad."""
    ok = members.groupBy(group).agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("_bad")).where("NOT _bad").select(group)
    return members.join(ok, group, "left_semi")
