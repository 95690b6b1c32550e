import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from quirelight.llm import exact_dedup as module
from quirelight.llm.exact_dedup import build_directory, exact_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOW)
        known = [x for x in groups[norm] if x is not None]
        keep = max(known) if known else None
        out.append((str(i), str(keep), len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("capacity", "hot"), [(4096, 1000), (3, 2)])
def test_exact_dedup(spark, monkeypatch, capacity, hot):
    monkeypatch.setattr(module, "_HOT", hot)
    texts = ["A b", "a B", "É", "é", "", None, "x" * 100_000, "X" * 100_000, "ı", "İ", "K"] + [f"t{i % 37}" for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "é"), (3, "other"), (None, "n"), (None, "a b")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, key string, sha int")
    got = exact_dedup(df, bucket_capacity=capacity).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain(rows)
    assert {r["chain"] for r in got} == {1}
    one = exact_dedup(df.withColumn("r", F.monotonically_increasing_id()), row_col="r", bucket_capacity=capacity).where("kept").collect()
    assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in one) == sorted({(k, sha) for _, k, _, _, sha in plain(rows)})
    assert exact_dedup(df.where("false")).collect() == []


def test_the_owner_compares_bytes(spark, monkeypatch):
    """Keys that collide: texts share a key, and still are told apart and chained."""
    monkeypatch.setattr(module.F, "xxhash64", lambda *c: F.length(F.col(c[0]) if isinstance(c[0], str) else c[0]).cast("long"))
    rows = [(i, t) for i, t in enumerate(["ab", "cd", "AB", "cd", "x", "ef", None])]
    got = module.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain(rows)
    assert {r["chain"] for r in got if r["group_size"] <= 2} >= {1, 2, 3}


def test_directory_doubles_where_it_overflows(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key")).union(spark.range(64).select((F.col("id") * 3).alias("key")))
    directory, depth = build_directory(keys, 100, 5)
    rows = directory.collect()
    assert sorted(r["slot"] for r in rows) == list(range(1 << depth))  # every slot, once
    counts = {r["slot"]: r["count"] for r in keys.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("slot")).count().collect()}
    held = defaultdict(int)
    for r in rows:
        assert r["slot"] >> (depth - r["local_depth"]) == r["bucket"] >> (depth - r["local_depth"])
        held[r["bucket"]] += counts.get(r["slot"], 0)
        assert 0 <= r["owner"] < 5
    assert max(held.values()) <= 100 and sum(held.values()) == keys.count()
    assert len({r["local_depth"] for r in rows}) > 1
