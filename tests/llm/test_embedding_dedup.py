import math

import numpy as np
from quirelight.llm.common import stage
from quirelight.llm.embedding_dedup import _split, build, near_duplicates, robust_prune, search


def vectors():
    r = np.random.default_rng(4)
    x = r.normal(size=(260, 16))
    x[100:200] = x[r.integers(0, 30, 100)] + r.normal(size=(100, 16)) * 0.18
    x[200:230] = x[5]
    x[230:260] = x[229] * r.uniform(0.5, 2, (30, 1))
    return x


def test_prune():
    x = np.array([[1.0, 0], [0.99, 0.14], [0.98, 0.2], [0, 1.0]])
    got = robust_prune(x, np.array([[1, 2, 3]]), 1.2, 3)
    assert got[0, 0] == 1 and 2 not in got[0] and 3 not in got[0][:1]


def test_search_finds_links():
    x = vectors()[:200]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if x[i] @ x[j] >= 0.9}
    got = set(map(tuple, search(x, build(x, 1.2, 0), 0.9, 48).tolist()))
    assert got <= want and len(got) >= 0.95 * len(want)


def test_against_all_pairs(spark):
    x = np.float32(vectors())
    rows = [(i * 2, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [math.nan] * 16, [math.inf] + [1.0] * 15, [-0.0] * 16]
    rows += [(1001 + 2 * i, v, 1) for i, v in enumerate(odd)] + [(0, x[0].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    got = near_duplicates(df, shard_size=120).collect()
    assert len(got) == len(rows)
    good = [(i, np.float64(v) / np.linalg.norm(np.float64(v))) for i, v, _ in rows if i % 2 == 0]
    ids = np.array([i for i, _ in good])
    near = np.array([v for _, v in good]) @ np.array([v for _, v in good]).T >= 0.9
    links = near.sum(1) - 1
    root = ids.copy()
    while True:
        new = np.array([root[near[i]].min() for i in range(len(ids))])
        if (new == root).all():
            break
        root = new
    want = {(int(i), int(n), int(c)) for i, n, c in zip(ids, links, root)} | {(1001 + 2 * i, 0, 1001 + 2 * i) for i in range(len(odd))}
    found = {(r["vec_id"], r["n_links"], r["component_id"]) for r in got}
    assert len(found & want) >= 0.95 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["recall"] >= 0.95 for r in got)
    assert near_duplicates(df.where("false")).collect() == []


def test_null_ids_link(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [1.0, 0.02]), (None, [0.0, 1.0]), (None, None), (7, [-1.0, 0.0]), (7, [0.0, -1.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(1, 2, 1), (None, 2, 1), (2, 2, 1), (None, 0, None), (None, 0, None), (7, 0, 7), (7, 0, 7)]
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got) == sorted(map(str, want))


def test_overfull_shards_are_split(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 8))
    x[:600] = x[0] + r.normal(size=(600, 8)) * 0.2  # one dense cluster
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dealt = stage(spark.createDataFrame([(i, 1, v.tolist(), 0) for i, v in enumerate(x)], "row long, n long, vector array<double>, shard long"), "dealt")
    got = _split(dealt, 8, 200, 500)
    assert got.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 400
    assert got.select("row").distinct().count() == 3000
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_size=150, max_sample=200).collect()
    links = (x @ x.T >= 0.9).sum(1) - 1
    assert sum(r["n_links"] for r in found) >= 0.9 * links.sum() and all(r["n_links"] <= links[r["vec_id"]] for r in found)
