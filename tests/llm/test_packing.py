from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quirelight.llm.packing import best_fit, pack

ITEMS = st.lists(st.tuples(st.integers(0, 20), st.integers(-1, 4), st.integers(-1, 6)), max_size=80)


@settings(max_examples=200, deadline=None)
@given(ITEMS)
def test_best_fit_equals_a_scan_of_all_bins(items):
    bins, want, offsets = [], [], []  # [left, sources, clusters]
    for n, s, c in items:
        fits = [b for b in range(len(bins)) if bins[b][0] >= n and (s < 0 or s not in bins[b][1]) and (c < 0 or c not in bins[b][2])]
        if fits:
            least = min(bins[b][0] for b in fits)
        else:
            bins.append([20, set(), set()])
            fits, least = [len(bins) - 1], 20
        got = best_fit(*map(list, zip(*items)), 20)[0][len(want)]
        assert got in fits and bins[got][0] == least  # any of the equally tight
        want.append(got)
        offsets.append(20 - bins[got][0])
        bins[got][0] -= n
        bins[got][1].add(s)
        bins[got][2].add(c)
    if items:
        assert best_fit(*map(list, zip(*items)), 20) == (want, offsets)


@pytest.mark.parametrize("cluster", [None, "c"])
def test_pack(spark, cluster):
    r = np.random.default_rng(0)
    rows = [(i, "ab" * int(r.integers(1, 60)), f"s{i % 3 if i % 2 else 0}", i % 7, "x") for i in range(300)]
    rows += [(300, None, None, None, "x"), (301, "", "s1", 1, "x"), (302, "é" * 5000, "s0", 1, "x"), (302, "é" * 5000, "s0", 1, "x"), (None, "t", "s", 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, c int, bin string")
    got = pack(df, capacity=100, group_size=128, cluster_col=cluster).collect()
    whole = defaultdict(int)
    for x in got:
        whole[x["doc_id"]] += x["n_bytes"]
    want = defaultdict(int)
    for x in rows:
        want[x[0]] += len((x[1] or "").encode()) + 1
    assert whole == want
    by = defaultdict(list)
    for x in got:
        by[x["bin"]].append(x)
    source, clusters = {x[0]: x[2] for x in rows}, {x[0]: (x[3] if cluster else x[1]) if x[1] else None for x in rows}
    for items in by.values():
        items.sort(key=lambda x: x["position"])
        assert [x["position"] for x in items] == list(range(len(items)))
        assert [x["offset"] for x in items] == np.cumsum([0, *(x["n_bytes"] for x in items)])[:-1].tolist()
        assert sum(x["n_bytes"] for x in items) <= 100
        for of in (source, clusters):
            held = [of[x["doc_id"]] for x in items if of[x["doc_id"]] is not None]
            assert len(held) == len(set(held))
    assert pack(df.where("false")).collect() == []
