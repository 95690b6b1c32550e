import re

import numpy as np
import pytest
import xxhash
from quirelight.llm.components import connected_components, stars
from quirelight.llm.simhash import _PIVOTS, _distances, _links_of, fingerprint, simhash_groups


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", " \t", "One", "a b c", "a b c d", "A  b\x0bC\xa0d é e f g h", "x " * 500, "É è " * 7 + "Z", "\x1fq w e r t"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain(text)


def roots(pairs, ids):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_links_reach_what_all_pairs_reach():
    r = np.random.default_rng(1)
    fp = r.integers(0, 2**64, 400, dtype=np.uint64)
    for i in range(100, 400):  # chains of neighbours, one of them long
        flips = r.choice(64, r.integers(1, 7), replace=False)
        fp[i] = fp[i - 1 if i > 250 else r.integers(0, i)] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
    want = [(i, j) for i in range(400) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 4]
    for bucket in (np.zeros(400, np.int64), np.arange(400) // 50):
        here = [(i, j) for i, j in want if bucket[i] == bucket[j]]
        table = np.bitwise_count(fp[:, None] ^ _PIVOTS).astype(np.int8)
        at = {int(f): i for i, f in enumerate(fp.view(np.int64))}
        found = [(at[a], at[b]) for a, b in _links_of(bucket, fp, table, 4).tolist()]
        assert roots(found, range(400)) == roots(here, range(400))


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (None, text), (None, text + " x"), (9, text + " x"), (9, "other"), (9, "other"), (None, "alone here"), (3, text)]
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fp = lambda t: f"{plain(t):016x}"
    near = (plain(text) ^ plain(text + " x")).bit_count() <= 4
    want = [(i, fp(t), None if t == "alone here" else 9 if t == "other" else 3 if near or t == text else 9) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_distances_are_those_to_the_pivots(spark):
    fp = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 50)
    got = spark.createDataFrame([(int(x),) for x in fp], "fp long").select("fp", *_distances()).collect()
    for r in got:
        bytes_ = np.array([r["d0"], r["d1"], r["d2"]], np.int64).view(np.uint8)
        assert bytes_.tolist() == [(int(p) ^ r["fp"] & (1 << 64) - 1).bit_count() for p in _PIVOTS]


def test_groups(spark):
    words = np.random.default_rng(2).choice([f"w{i}" for i in range(500)], (12, 150))
    texts = [" ".join(x) for x in words]
    texts += [t + " more" for t in texts[:6]] + [t.upper() for t in texts[:3]] + TEXTS + [None, None, texts[0]]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = {i: plain(t) for i, t, _ in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    want = roots(pairs, fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    r = np.random.default_rng(3)
    pairs = r.integers(0, 300, (200, 2)).tolist() + [[i, i + 1] for i in range(500, 560)] + [[7, 7]]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = {x["id"]: x["component"] for x in connected_components(links).collect()}
    ids = {i for a, b in pairs for i in (a, b) if a != b}
    assert got == {i: v for i, v in roots(pairs, {i for p in pairs for i in p}).items() if i in ids}
    every = {i for p in pairs for i in p}
    assert roots(stars(np.array(pairs)).tolist(), every) == roots(pairs, every)
