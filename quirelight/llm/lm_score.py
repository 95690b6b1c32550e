"""Stupid-backoff language-model scores of all documents, each judged by the others.

    S(w | u v) = c(u v w) / c(u v)  if c(u v w) > 0,  else  backoff * S(w | v)
    S(w)       = c(w) / N           if c(w) > 0,      else  backoff / N

Counts are over the whole corpus less the document that is scored; N is the corpus's
words. A text's log score is the sum of ln S over its words.

Counting, joining and summing are three relations over n-grams of all orders, each a
64-bit hash:
1. requests (chunk, n, part, grams with counts): documents are dealt to chunks, and a
   chunk's n-grams are exploded and counted before they travel;
2. counts: the count table, partitioned into ``parts`` ranges of the hash. Each partition
   sums the requests and is joined with them: a reply (chunk, n, part, totals);
3. scores: replies meet their chunk's documents, and are summed for each document.

A row of (1) and (2) holds a sorted run of n-grams as packed differences instead of one
n-gram, which makes them several times smaller; the join is a merge of sorted runs. A
chunk is of bounded size and has at most ``parts`` rows for each order, so rows grow with
the input. Where a partition would outgrow ``part_bytes``, groups of chunks merge their
requests first, split the partition's range further, and hand the totals back: each step
then handles ``part_bytes`` at a time, at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require
from .hashing import Hashes, compress, give_back, mix

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ALL = np.uint64(2**64 - 1)  # stands for the number of words
_STEP = 1 << 20  # bytes hashed at a time


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text). A-Z lower-cased; split at white space."""
    hashes, sizes = [], []
    at = 0
    while at < len(texts):
        upto, room = at + 1, _STEP - len(texts[at])
        while upto < len(texts) and room > len(texts[upto]):
            room -= len(texts[upto])
            upto += 1
        x = np.frombuffer(b"\n".join([*(t.lower() for t in texts[at:upto]), b""]), np.uint8)
        space = np.concatenate([[True], _SPACE[x]])
        first = np.flatnonzero(space[:-1] & ~space[1:])
        last = np.flatnonzero(~space[:-1] & space[1:])
        hashes.append(Hashes(x, 0)(first, last))
        ends = np.cumsum(np.array([len(t) + 1 for t in texts[at:upto]]))
        sizes.append(np.diff(np.searchsorted(first, ends), prepend=0))
        at = upto
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(sizes)


def gram_hashes(words: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For each order from 1 on, the hash of the n-gram that ends at each word; n-grams
    that would begin before their text have the hash 0."""
    place = np.arange(len(words), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    grams = np.clip(mix(words), np.uint64(1), _ALL - np.uint64(1))
    yield grams
    for n in range(2, order + 1):
        longer = np.zeros(len(words), np.uint64)
        longer[1:] = np.clip(mix(grams[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(n)), np.uint64(1), _ALL - np.uint64(1))
        longer[place < n - 1] = 0
        grams = longer
        yield grams


def counted(grams: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of an order, sorted, their counts, the place in them of each word's n-gram).
    0 is left out: its place is -1. ``first``: the number of words comes last, as one more."""
    some = grams != 0
    keys, place, counts = np.unique(grams[some], return_inverse=True, return_counts=True)
    where = np.full(len(grams), -1, np.int32)
    where[some] = place
    if first:
        keys, counts = np.append(keys, _ALL), np.append(counts, len(grams))
    return keys, counts, where


def _pack(x: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    return z.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes, z: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = np.frombuffer(z.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _bounds(keys: np.ndarray, pieces: int, of: int = 0, outer: int = 1) -> np.ndarray:
    """Where each of ``pieces`` equal ranges of hashes begins among sorted keys, and their end.
    They make up range number ``of`` of ``outer`` equal ones."""
    low = np.array([((of * pieces + i) << 64) // (outer * pieces) for i in range(pieces)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, low), len(keys))


def _split(keys: np.ndarray, counts: np.ndarray, at: np.ndarray, z) -> Iterator[tuple[int, bytes, bytes]]:
    for p in np.flatnonzero(np.diff(at)):
        run = slice(at[p], at[p + 1])
        yield int(p), _pack(np.diff(keys[run], prepend=np.uint64(0)), z), _pack(counts[run], z)


_REQUEST = {"chunk": pa.int32(), "n": pa.int32(), "part": pa.int32(), "grams": pa.binary(), "counts": pa.binary()}
_MERGED = {"team": pa.int32(), "n": pa.int32(), "part": pa.int32(), "piece": pa.int32(), "grams": pa.binary(), "counts": pa.binary()}


def _rows(rows: list[tuple], kinds: dict) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def _requests(order: int, parts: int):
    def run(t: pa.Table) -> pa.Table:
        unz, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        words, sizes = word_hashes([unz.decompress(d) for d in t["z"].to_pylist()])
        rows, chunk = [], t["chunk"][0].as_py()
        for n, grams in enumerate(gram_hashes(words, sizes, order), 1):
            keys, counts, _ = counted(grams, n == 1)
            rows += [(chunk, n, *x) for x in _split(keys, counts, _bounds(keys, parts), z)]
            del keys, counts, _
            give_back()
        return _rows(rows, _REQUEST)

    return run


def _summed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(n-grams, their total counts, the places in them of each row's)."""
    unz = zstandard.ZstdDecompressor()
    runs = [np.cumsum(_unpack(d, unz), dtype=np.uint64) for d in t["grams"].to_pylist()]
    keys, place = np.unique(np.concatenate(runs), return_inverse=True)
    total = np.bincount(place, np.concatenate([_unpack(d, unz) for d in t["counts"].to_pylist()])).astype(np.uint64)
    return keys, total, np.split(place, np.cumsum([len(r) for r in runs])[:-1])


def _count_and_join(keep: list[str]):
    def run(t: pa.Table) -> pa.Table:
        z = zstandard.ZstdCompressor(level=1)
        _, total, places = _summed(t)
        return t.select(keep).append_column("totals", pa.array([_pack(total[p], z) for p in places], pa.binary()))

    return run


def _merge(parts: int, pieces: int):
    """Requests of a team's chunks for a part -> one for each piece of its range."""

    def run(t: pa.Table) -> pa.Table:
        z = zstandard.ZstdCompressor(level=1)
        keys, total, _ = _summed(t)
        team, n, part = (t[c][0].as_py() for c in ("team", "n", "part"))
        return _rows([(team, n, part, *x) for x in _split(keys, total, _bounds(keys, pieces, part, parts), z)], _MERGED)

    return run


def _hand_back(t: pa.Table, replies: pa.Table) -> pa.Table:
    """A team's requests and the totals of their pieces -> replies to its chunks."""
    unz, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    keys, _, places = _summed(t)
    total = np.concatenate([np.empty(0, np.uint64), *(_unpack(d, unz) for d in replies.sort_by("piece")["totals"].to_pylist())])
    if len(total) != len(keys):
        raise ValueError("replies don't match the team's n-grams")
    return t.select(["chunk", "n", "part"]).append_column("totals", pa.array([_pack(total[p], z) for p in places], pa.binary()))


def _answered(requests: DataFrame, parts: int, teams: int) -> DataFrame:
    """requests -> (chunk, n, part, totals)."""
    if teams == 1:
        return requests.groupBy("part", "n").applyInArrow(_count_and_join(["chunk", "n", "part"]), "chunk int, n int, part int, totals binary")
    dealt = requests.withColumn("team", F.pmod(F.xxhash64("chunk"), F.lit(teams)).cast("int"))
    group = ["team", "part", "n"]
    merged = dealt.groupBy(*group).applyInArrow(_merge(parts, teams), "team int, n int, part int, piece int, grams binary, counts binary")
    totals = merged.groupBy("part", "piece", "n").applyInArrow(_count_and_join(["team", "n", "part", "piece"]), "team int, n int, part int, piece int, totals binary")
    return dealt.groupBy(*group).cogroup(totals.groupBy(*group)).applyInArrow(_hand_back, "chunk int, n int, part int, totals binary")


def from_others(where: np.ndarray, totals: np.ndarray, document: np.ndarray) -> np.ndarray:
    """For each word, how often other documents have its n-gram; 0 where it has none."""
    has = np.flatnonzero(where >= 0)
    out = np.zeros(len(where))
    if len(has):
        key = document[has].astype(np.int64) * len(totals) + where[has]
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        own = np.repeat(np.diff(np.r_[first, len(key)]), np.diff(np.r_[first, len(key)]))
        del key
        at = has[order]
        out[at] = totals[where[at]].astype(float) - own
    return out


def _scores(order: int, backoff: float, names: list[str]):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        unz = zstandard.ZstdDecompressor()
        words, sizes = word_hashes([unz.decompress(d) for d in t["z"].to_pylist()])
        ids = t["id"]
        del t
        document = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        replies = replies.sort_by("part")
        score, context = None, None
        for n, grams in enumerate(gram_hashes(words, sizes, order), 1):
            keys, _, where = counted(grams, n == 1)
            keys = len(keys)
            mine = replies.filter(pc.equal(replies["n"], n))
            totals = np.concatenate([np.empty(0, np.uint64), *(_unpack(d, unz) for d in mine["totals"].to_pylist())])
            if len(totals) != keys:
                raise ValueError("replies don't match the chunk's n-grams")
            others = from_others(where, totals, document)
            if n == 1:
                score = np.where(others > 0, others, backoff) / max(1.0, float(totals[-1]))
            else:
                before = np.ones(len(score))
                before[1:] = context[:-1]
                seen = others > 0
                score = np.where(seen, others / np.where(seen, before, 1), np.where(where >= 0, backoff * score, score))
            context = others
            del where, totals, others, mine, grams
            give_back()
        each = np.bincount(document, np.log(score), minlength=len(sizes)).astype(float)
        return pa.table([ids, pa.array(sizes.astype(np.int64)), pa.array(each)], names)

    return run


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, backoff: float = 0.4, chunk_bytes: int = 10 << 20, parts: int = 1024, part_bytes: int = 12 << 20) -> DataFrame:
    """One row per row of ``docs``: id, n_words, log_score, mean_log_score.

    Null and empty texts have no words and score 0. A text is scored whole in one task,
    however long. Copies of a document count as other documents. Null and repeated ids keep
    their rows, and rows that repeat are dealt to chunks like others. Scores are sums, so
    ties need no order. Other columns are ignored. An empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks, teams = max(1, math.ceil(size / chunk_bytes)), max(1, math.ceil(size / (parts * part_bytes)))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["z", "chunk", "id"]
    chunk = F.pmod(F.xxhash64(id_col, text_col, F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    rows = docs.select(F.col(text_col).alias("text"), chunk.alias("chunk"), F.col(id_col).alias("id"))
    packed = rows.mapInArrow(compress(names), f"z binary, chunk int, id {kind}")
    requests = packed.groupBy("chunk").applyInArrow(_requests(order, parts), "chunk int, n int, part int, grams binary, counts binary")
    replies = _answered(requests, parts, teams)
    out = [id_col, "n_words", "log_score"]
    scored = packed.groupBy("chunk").cogroup(replies.select(F.col("chunk").alias("of"), "n", "part", "totals").groupBy("of")).applyInArrow(_scores(order, backoff, out), f"`{id_col}` {kind}, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.col("log_score") / F.greatest(F.col("n_words"), F.lit(1)))
