import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from quirelight.llm.lm_score import _requests, stupid_backoff


def plain(texts, order, backoff):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    grams = lambda d: Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1))
    all_, total = sum(map(grams, docs), Counter()), sum(map(len, docs))
    out = []
    for d in docs:
        own, score = grams(d), 0.0
        c = lambda g: all_[g] - own[g]  # noqa: E731, B023

        def s(g):
            if len(g) == 1:
                return (c(g) if c(g) > 0 else backoff) / total  # noqa: B023
            return c(g) / c(g[:-1]) if c(g) > 0 else backoff * s(g[1:])  # noqa: B023

        for i in range(len(d)):
            score += math.log(s(tuple(d[max(0, i - order + 1) : i + 1])))
        out.append((len(d), score))
    return out


@pytest.mark.parametrize("order,chunk,parts,part_bytes", [(3, 2000, 7, 1 << 20), (1, 1 << 20, 1, 1 << 20), (2, 300, 3, 2000), (3, 2000, 5, 700)])
def test_against_plain_counts(spark, order, chunk, parts, part_bytes):
    r = np.random.default_rng(0)
    texts = [" ".join(r.choice(["The", "the", "cat", "é", "sat", "on", "mat,", "x"], r.integers(0, 40))) for _ in range(80)]
    texts += [None, "", "\n ", "one\ttwo\x0bthree", texts[3], texts[3], "lonely", "w " * 9000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "the cat", 1), (5, texts[5], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int")
    want = sorted((str(r[0]), n, s) for r, (n, s) in zip(rows, plain([r[1] for r in rows], order, 0.4)))
    got = sorted((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in stupid_backoff(df, order=order, chunk_bytes=chunk, parts=parts, part_bytes=part_bytes).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_rows_grow_with_the_input(spark):
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice([f"w{i}" for i in range(3000)], 200)) for _ in range(64)]
    size = {}
    for k in (16, 64):
        z = zstandard.ZstdCompressor()
        made = [_requests(3, 32)(pa.table({"z": [z.compress(t.encode()) for t in texts[i : i + 4]], "chunk": [i] * 4})).num_rows for i in range(0, k, 4)]
        size[k] = sum(made)
    assert size[64] == 4 * size[16] == 16 * 3 * 32


def test_rows_that_repeat_are_spread(spark):
    df = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    got = stupid_backoff(df, chunk_bytes=100, parts=2).collect()
    assert len(got) == 400 and len({r["log_score"] for r in got}) == 1


def test_empty(spark):
    assert stupid_backoff(spark.createDataFrame([], "doc_id long, text string")).collect() == []
