import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quirelight.llm import suffix_dedup
from quirelight.llm.suffix_dedup import remove_repeats
from quirelight.llm.suffix_sort import common_prefixes, sparse_suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=30).map(str.encode), max_size=6), st.integers(1, 6))
def test_suffixes_are_sorted(segments, length):
    order, base, buffer = sparse_suffix_array(segments, length) if segments else (np.empty(0, int), [], b"")
    want = sorted(b + i for b, s in zip(base, segments) for i in range(len(s) - length + 1))
    assert sorted(order.tolist()) == want
    keys = [buffer[i : i + length] for i in order]
    assert keys == sorted(keys)
    if len(order):
        prefixes = common_prefixes(order, buffer, length)
        for i in range(1, len(order)):
            a, b = keys[i - 1], keys[i]
            assert prefixes[i] == next((k for k in range(length) if a[k] != b[k]), length)


def plain(texts, length):
    at = defaultdict(set)
    data = [(t or "").encode() for t in texts]
    for d, t in enumerate(data):
        for i in range(len(t) - length + 1):
            at[t[i : i + length]].add((d, i))
    out = []
    for d, t in enumerate(data):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if len(at[t[i : i + length]]) > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def corpus():
    r = np.random.default_rng(5)
    noise = lambda n: "".join(r.choice(list("abcdeé "), n))
    shared, other = noise(150), noise(90)
    texts = [noise(40) + shared + noise(30) for _ in range(30)]  # one passage in many
    texts += [noise(5) + shared[int(r.integers(0, 60)) : int(r.integers(90, 150))] + noise(20) for _ in range(30)]
    texts += [other + noise(9) + other, "a" * 300, "ab" * 100, "xyz" * 30, "a" * 39, "a" * 40, "", None, noise(300)]
    texts += [texts[3], texts[3], noise(10) + texts[5][20:], noise(2000) + other[3:70]]
    near = noise(400)
    for _ in range(20):
        k = int(r.integers(0, 399))
        texts.append(near[:k] + "#" + near[k + 1 :])
    return texts


@pytest.mark.parametrize("passage", [None, 25])
@pytest.mark.parametrize("most_reaches", [2000, 3])
def test_remove_repeats(spark, most_reaches, passage):
    texts = corpus()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, "q" * 10, "x", 1), (None, texts[0], "x", 1)]
    want = sorted(zip((str(r[0]) for r in rows), plain([r[1] for r in rows], 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string, z string, b int")
    gram = {"gram": 20} if passage is None else {"passage": passage}
    got = remove_repeats(df, length=40, keep=["z"], block_bytes=3000, most_reaches=most_reaches, **gram).collect()
    assert sorted((str(x["doc_id"]), tuple(x[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))) for x in got) == want
    for x in got:
        assert sum(r["end"] - r["begin"] for r in x["removed"]) == x["n_removed"]
    if passage:
        want = sorted(zip((str(r[0]) for r in rows), plain([r[1] for r in rows], passage)))
        assert sorted((str(x["doc_id"]), (x["n_bytes"], sum(r["end"] - r["begin"] for r in x["passages"]), len(x["passages"]))) for x in got) == [(i, w[:3]) for i, w in want]


def test_pieces_of_long_texts(monkeypatch):
    r = np.random.default_rng(2)
    texts = [bytes(r.choice(list(b"abcd"), n).astype(np.uint8)) for n in (5000, 10, 39, 40, 41, 700, 0, 3000)]
    whole = [set(zip(*(c.tolist() for c in suffix_dedup.anchors([t], 25, 12)))) for t in texts]
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 200)
    got = [set(zip(*(c.tolist() for c in suffix_dedup.anchors([t], 25, 12)))) for t in texts]
    assert got == whole and all(w for t, w in zip(texts, whole) if len(t) >= 25)
    together = set(zip(*(c.tolist() for c in suffix_dedup.anchors(texts, 25, 12))))
    assert together == {(i, *a[1:]) for i, w in enumerate(whole) for a in w}
    assert {a[:3] for a in together} == set(zip(*(c.tolist() for c in suffix_dedup.anchors(texts, 25, 12, False))))


def test_least_words(spark):
    line = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"one {line} a"), (2, f"two {line} b"), (3, f"three {line[:200]} c"), (4, line[:30])], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split() for r in remove_repeats(df, keep=[], length=100, least_words=50).collect()}
    assert len(got[1]) <= 2 and len(got[2]) <= 2 and len(got[3]) > 25  # a part of it that has too few words stays


def test_rows_that_repeat_have_spans_of_their_own(spark):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 4000))
    df = spark.range(800).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = remove_repeats(df).collect()
    assert len(got) == 800 and all(r["n_removed"] == 4000 and r["n_spans"] == 1 for r in got)


def test_text_and_columns(spark):
    rows = [(1, "é" * 30, "k"), (2, "a" + "é" * 30, None), (3, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["source"], r["text"]) for r in remove_repeats(df, keep=["source"], length=10, gram=4).collect()}
    assert got == {1: ("k", ""), 2: (None, "a"), 3: ("n", "")}
    assert remove_repeats(df.where("false"), keep=[]).collect() == []


def test_long_common_prefixes(spark):
    segments = [b"ab" * 400, b"ab" * 200 + b"c" + b"ab" * 200]
    order, base, buffer = sparse_suffix_array(segments, 399)
    keys = [buffer[i : i + 399] for i in order]
    assert keys == sorted(keys)
    for p, a, b in zip(common_prefixes(order, buffer, 399)[1:], keys, keys[1:]):
        assert p == next((k for k in range(399) if a[k] != b[k]), 399)
