import zlib
from collections import defaultdict

import numpy as np
from quirelight.llm.sharding import _cuts, shard_by_bytes


def check(got, rows, shards):
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [size[i] for i in range(shards)]


def test_shards(spark):
    r = np.random.default_rng(0)
    rows = [(i, "é" * int(r.integers(0, 400))) for i in range(3000)] + [(5, None), (5, "é"), (None, "z"), (None, None)]
    rows += [(10_000 + i, "the same text " * 40) for i in range(800)]  # a third of all bytes
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, size int, shard string")
    size = check(shard_by_bytes(df).collect(), rows, 16)
    assert max(size) - min(size) < 0.03 * sum(size) / 16 + 1600


def test_few_rows_and_a_long_one(spark):
    rows = [(1, "x"), (2, "y" * 1_000_000), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(shard_by_bytes(df, shards=4).collect(), rows, 4)
    assert shard_by_bytes(df.where("false")).collect() == []


def together(got):
    of, size = defaultdict(set), defaultdict(int)
    for r in got:
        of[r["text_crc32"]].add(r["shard"])
        size[r["text_crc32"]] += r["size"]
    return {k: len(v) for k, v in of.items()}, size


def test_equal_texts_share_a_shard(spark):
    for rows in ([(i, f"text number {i % 150} " * 9) for i in range(1500)], [(i, f"{i % 3000:05} " * 20) for i in range(9000)]):
        got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        size = check(got, rows, 16)
        assert set(together(got)[0].values()) == {1}
        assert max(size) - min(size) < 0.1 * sum(size) / 16


def test_groups_larger_than_cells_stay_whole(spark):
    rows = [(None, f"{'x' * 50} {i}" if i % 2 else f"group {i % 18} " * 12) for i in range(4000)]
    rows += [(None, "a third of all rows")] * 8000
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = check(got, rows, 16)
    of, held = together(got)
    assert all(n == 1 for k, n in of.items() if held[k] <= sum(size) / 16)
    assert max(of.values()) > 1 and max(size) - min(size) < 0.1 * sum(size) / 16


def test_cuts_fill_up_to_one_level():
    assert _cuts([0, 0, 0, 0], 8) == [2, 4, 6]
    assert _cuts([5, 0, 0, 3], 4) == [0, 2, 4]
    assert _cuts([5, 0, 0, 3], 12) == [0, 5, 10]
