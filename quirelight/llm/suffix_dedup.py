"""Removing byte strings that start in two places or more, by suffix arrays.

What repeats is judged over all documents: every string of ``length`` bytes (400) that
starts anywhere else, in the same document too, is removed wherever it covers bytes.

1. Anchors. Each string of ``length`` bytes has one or more anchors: the ``gram``-byte
   grams with the least hash in it (all of them on ties). Which these are depends on the
   string only, so equal strings have equal anchors. An anchor's reach is all that strings
   with that anchor can cover. Grams that occur once in the corpus cannot be in a repeat.
2. Copies. Anchors with equal grams and equal reach (two independent 64-bit hashes, so
   128 bits) are merged before anything is gathered: of several copies, every string
   within reach repeats, and one copy stands for all from here on.
3. Suffix arrays. Where a gram has several different reaches, these are brought together
   by gram and their strings are suffix-sorted in two stages (suffix_sort.py); common
   prefixes of neighbours tell which of them repeat. A task sorts blocks of about
   ``block_bytes`` made of whole grams.
4. Very common grams (over ``most_reaches`` different reaches) are split before that:
   the range of strings is halved, each half is grouped by the bytes that all its strings
   share, and so on. What is then unique, or a copy, is settled; small groups go to the
   suffix arrays. At one string a half is the string itself, so this ends, and is exact.

Texts are written once, compressed, with a number for each row, and are read from there:
by the anchors, to cut the reaches out, and to remove the spans.

Where shorter passages are asked for too, these are found first, over whole texts. What
repeats over ``length`` bytes lies within their runs, and is then looked for in the runs of
that size only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, slices, stage
from .hashing import Hashes, compress
from .suffix_sort import repeated_starts

_BLOCK = 1 << 17  # bytes that anchors are searched in at a time


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over all windows, in two passes over blocks of the width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, x[-1], x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    onward = op.accumulate(blocks, 1).ravel()
    back = op.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return op(back[: n - width + 1], onward[width - 1 : n])


def _least_of_some(h: np.ndarray, room: int, ends: np.ndarray) -> np.ndarray:
    """Whether a gram has the least hash in one of the strings, whose grams are ``room`` + 1.
    ends: the strings that begin here lie in no text."""
    least = np.zeros(len(h) + room, np.uint64)
    least[room : len(h)] = _slide(h, room + 1, np.minimum)
    least[room + ends] = 0
    return _slide(least, room + 1, np.maximum) == h


def _before(ends: np.ndarray, size: int, below: int) -> np.ndarray:
    """Where what has ``size`` bytes would cross one of the ends."""
    at = (ends[:, None] - np.arange(1, size)).ravel()
    return at[(at >= 0) & (at < below)]


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Lists of pieces (text, begin, end, first gram to report, end of these) of about _BLOCK
    bytes each: short texts together, long ones cut, with ``length`` bytes more on either side."""
    held, size = [], 0
    for d, t in enumerate(texts):
        for at in range(0, len(t), _BLOCK):
            low, high = max(0, at - length), min(len(t), at + _BLOCK + length)
            if held and size + high - low > _BLOCK:
                yield held
                held, size = [], 0
            held.append((d, low, high, at, min(len(t), at + _BLOCK)))
            size += high - low
    if held:
        yield held


def anchors(texts: list[bytes], length: int, gram: int, reaches: bool = True) -> tuple[np.ndarray, ...]:
    """(text, position, hash of the gram[, hash of the reach]) of all anchors."""
    out = []
    texts = [t if len(t) >= length else b"" for t in texts]
    room = length - gram
    for pieces in _pieces(texts, length):
        x = np.frombuffer(b"".join(texts[d][a:b] for d, a, b, _, _ in pieces), np.uint8)
        if len(x) < length:
            continue
        text, low, high, first, last = np.array(pieces).T
        end = np.cumsum(high - low)
        base = end - (high - low)
        h = Hashes(x, 0).windows(gram)
        h[_before(end, gram, len(h))] = ~np.uint64(0)
        pos = np.flatnonzero(_least_of_some(h, room, _before(end, length, len(h) - room)))
        of = np.searchsorted(end, pos, "right")
        inside = pos + gram <= end[of]
        pos, of = pos[inside], of[inside]
        own = pos - base[of] + low[of]
        mine = (own >= first[of]) & (own < last[of])
        pos, of, own = pos[mine], of[mine], own[mine]
        found = [text[of], own, h[pos].view(np.int64)]
        if reaches:
            a, b = np.maximum(pos - room, base[of]), np.minimum(pos + length, end[of])
            found.append((Hashes(x, 1)(a, b) + (pos - a).astype(np.uint64)).view(np.int64))
        out.append(found)
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4 if reaches else 3))
    return tuple(map(np.concatenate, zip(*out)))


def _unpacked(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    z = zstandard.ZstdDecompressor()
    for x in slices(batches, rows):
        yield x, [z.decompress(t) for t in x.column(0).to_pylist()]


def _gram_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(texts, length, gram, False)[2])], ["core"])

    return run


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, texts in _unpacked(batches):
            text, pos, core, reach = anchors(texts, length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x.column(1).to_numpy()[text], pos.astype(np.int32), core, reach)], ["row", "pos", "core", "reach"])

    return run


_SEG = {"core": pa.int64(), "hot": pa.bool_(), "row": pa.int64(), "b": pa.int32(), "anchor": pa.int32(), "n": pa.int64(), "seg": pa.binary()}


def _cut(length: int, gram: int):
    """(z, row, wanted) -> segments: the reach of every wanted anchor."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SEG.values())], list(_SEG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for x, texts in _unpacked(batches, 64):
            for text, row, wanted in zip(texts, x.column(1).to_pylist(), x.column(2).to_pylist()):
                for w in wanted:
                    a = max(0, w["pos"] - (length - gram))
                    rows.append((w["core"], w["hot"], row, a, w["pos"] - a, w["n"], text[a : w["pos"] + length]))
                    if len(rows) >= 5000:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    return run


def _sorted_blocks(length: int, block_bytes: int):
    """Segments in order of ``core`` -> spans (row, b, e) of those that have one copy."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        row, begin, copies = rows["row"].to_numpy(), rows["b"].to_numpy().astype(np.int64), rows["n"].to_numpy()
        document = np.unique(row, return_inverse=True)[1].ravel()
        segment, offset = repeated_starts(rows["seg"].to_pylist(), document, begin, copies, length)
        one = copies[segment] == 1
        segment, offset = segment[one], offset[one]
        order = np.lexsort((offset, segment))
        segment, offset = segment[order], offset[order]
        new = np.ones(len(segment), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(segment)) - 1 if len(first) else first
        s = segment[first]
        arrays = [row[s], (begin[s] + offset[first]).astype(np.int32), (begin[s] + offset[last] + length).astype(np.int32)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), ["row", "b", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for x in slices(batches, 1 << 13):
            at = 0
            while at < x.num_rows:  # slices that end with a gram, of about block_bytes
                core = x.column(0).to_numpy()
                upto = min(x.num_rows, at + max(1, block_bytes // 600))
                stop = int(np.searchsorted(core, core[upto - 1], "right"))
                if held and core[at] != held[-1].column(0)[-1].as_py() and sum(h.nbytes for h in held) >= block_bytes:
                    yield spans(pa.Table.from_batches(held))
                    held = []
                held.append(x.slice(at, stop - at))
                at = stop
        if held:
            yield spans(pa.Table.from_batches(held))

    return run


def _settle_hot(items: DataFrame, size: int, gram: int, most_reaches: int) -> tuple[DataFrame, DataFrame]:
    """items: segments of very common grams. Returns (spans, segments for suffix arrays), of
    strings of ``size`` bytes.

    A string starts d bytes before its anchor, d from d1 to d2. All strings of the range
    share the bytes [anchor - d1, anchor - d2 + size); together they cover
    [anchor - d2, anchor - d1 + size), as far as the segment goes."""
    done, small = [], []
    todo = items.select("row", "b", "anchor", "n", "seg", F.col("core").alias("grp"), F.lit(0).alias("d1"), F.lit(size - gram).alias("d2"))
    a, end = F.col("anchor"), F.octet_length("seg")
    while True:  # ranges halve, so this ends
        middle = F.expr("cast((d1 + d2) div 2 as int)")
        halves = F.when(F.col("d1") < F.col("d2"), F.array(F.struct(F.col("d1").alias("d1"), middle.alias("d2")), F.struct((middle + 1).alias("d1"), F.col("d2").alias("d2")))).otherwise(F.array(F.struct("d1", "d2")))
        half = todo.withColumn("h", F.explode(halves)).select("row", "b", "anchor", "n", "seg", "grp", "h.d1", "h.d2")
        # ranges without a whole string in the segment go
        half = half.where((F.col("d1") <= a) & (a - F.col("d2") + size <= end))
        low, high = F.greatest(a - F.col("d2"), F.lit(0)), F.least(a - F.col("d1") + size, end)
        half = half.withColumn("low", low).withColumn("high", high)
        half = half.withColumn("grp", F.xxhash64("grp", "d1", F.substr(F.col("seg"), a - F.col("d1") + 1, F.col("d1") - F.col("d2") + size)))
        half = half.withColumn("own", F.substr(F.col("seg"), F.col("low") + 1, F.col("high") - F.col("low")))
        half = half.withColumn("own", F.xxhash64(F.sha2("own", 256), a - F.col("low"))).withColumn("place", F.struct("row", "b", "anchor"))
        owns = half.groupBy("grp", "own").agg(F.sum("n").alias("all"), F.min("place").alias("stands"))
        grps = owns.groupBy("grp").agg(F.count("*").alias("owns"), F.sum("all").alias("total")).where("total > 1")
        half = stage(half.join(owns, ["grp", "own"]).join(grps, "grp"), "halves")
        done.append(half.where("all > 1 AND n = 1").select("row", (F.col("b") + F.col("low")).alias("b"), (F.col("b") + F.col("high")).alias("e")))
        mixed = half.where("owns > 1 AND place = stands")
        few = mixed.where(F.col("owns") <= most_reaches)
        small.append(few.select(F.col("grp").alias("core"), "row", (F.col("b") + F.col("low")).alias("b"), F.col("all").alias("n"), F.substr(F.col("seg"), F.col("low") + 1, F.col("high") - F.col("low")).alias("seg")))
        todo = mixed.where((F.col("owns") > most_reaches) & (F.col("d1") < F.col("d2"))).select("row", "b", "anchor", F.col("all").alias("n"), "seg", "grp", "d1", "d2")
        if todo.isEmpty():
            break
    return _union(done), _union(small)


def _union(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else _union([parts[0].unionByName(parts[1]), *parts[2:]])


def repeated_spans(packed: DataFrame, length: int = 400, gram: int | None = None, block_bytes: int = 1 << 18, most_reaches: int = 2000) -> DataFrame:
    """packed: (z, row): compressed texts, and a number for each row. Returns spans (row, b, e),
    overlapping ones among them, that together cover what repeats; e may lie beyond the text.
    ``gram`` is three quarters of ``length`` by default."""
    gram = gram or max(1, length * 3 // 4)
    if not 0 < gram < length:
        raise ValueError("gram must be positive and less than length")
    texts = packed.select("z", "row")
    grams = texts.mapInArrow(_gram_rows(length, gram), "core long")
    again = stage(grams.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "grams")  # written, so that the join may split a hot gram
    found = texts.mapInArrow(_anchor_rows(length, gram), "row long, pos int, core long, reach long")
    hits = stage(found.join(again.hint("shuffle_hash"), "core", "left_semi"), "anchors", [again])
    reaches = stage(hits.groupBy("core", "reach").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("rep")), "reaches")
    copies = reaches.where("n > 1").select("core", "reach")
    spans = hits.join(copies, ["core", "reach"], "left_semi").select("row", F.greatest(F.col("pos") - (length - gram), F.lit(0)).alias("b"), (F.col("pos") + length).alias("e"))
    mixed = reaches.groupBy("core").agg(F.count("*").alias("reaches")).where("reaches > 1")
    wanted = reaches.join(mixed, "core").select("rep.row", F.struct("core", (F.col("reaches") > most_reaches).alias("hot"), "rep.pos", "n").alias("w"))
    wanted = wanted.groupBy("row").agg(F.collect_list("w").alias("wanted"))  # of one text
    joined = texts.join(wanted.hint("shuffle_hash"), "row").select("z", "row", "wanted")
    segments = stage(joined.mapInArrow(_cut(length, gram), "core long, hot boolean, row long, b int, anchor int, n long, seg binary"), "segments")
    small = segments.where("NOT hot").select("core", "row", "b", "n", "seg")
    hot = segments.where("hot")
    if not hot.isEmpty():
        more, few = _settle_hot(hot, length, gram, most_reaches)
        spans, small = spans.unionByName(more), small.unionByName(few)
    by_array = small.repartition("core").sortWithinPartitions("core").mapInArrow(_sorted_blocks(length, block_bytes), "row long, b int, e int")
    return spans.unionByName(by_array)


def _gathered(spans: DataFrame) -> DataFrame:
    return spans.groupBy("row").agg(F.collect_list("b").alias("b"), F.collect_list("e").alias("e"))  # of one text


def _runs(b: list[int] | None, e: list[int] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of spans."""
    runs: list[list[int]] = []
    for low, high in sorted(zip(b or (), e or ())):
        high = min(high, size)
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high)
        else:
            runs.append([low, high])
    return [(low, high) for low, high in runs]


def _runs_cut(least: int):
    """(z, row, b, e) -> (z, row, begin, size): the runs of ``least`` bytes or more, as texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for x, texts in _unpacked(batches, 64):
            rows = [(z.compress(text[low:high]), row, low, high - low) for text, row, b, e in zip(texts, *(x.column(i).to_pylist() for i in (1, 2, 3))) for low, high in _runs(b, e, len(text)) if high - low >= least]
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.int32()))], ["z", "of", "begin", "size"])

    return run


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return text
    left, at = [], 0
    for low, high in runs:
        left.append(text[at:low])
        at = high
    return b"".join([*left, text[at:]])


def _removed(names: list[str], texts: bool, passages: bool, least_words: int):
    """(z, spans, spans of passages, others) -> the counts, the digest of what is left, and what else is asked for."""
    run_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    as_runs = lambda each: pa.array([[{"begin": a, "end": b} for a, b in r] for r in each], run_type)
    decoded = lambda data: data.decode("utf-8", "ignore")  # noqa: E731  halves of characters at a cut go

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, whole in _unpacked(batches, 128):
            counts, digests, kept, gone, short, rest = [], [], [], [], [], []
            for text, b, e, pb, pe in zip(whole, *(x.column(i).to_pylist() for i in (1, 2, 3, 4))):
                wordy = lambda runs: [r for r in runs if len(text[slice(*r)].split()) >= least_words]  # noqa: E731, B023
                runs = _runs(b, e, len(text))
                if least_words and not passages:
                    runs = wordy(runs)
                left = _without(text, runs)
                counts.append((len(text), len(text) - len(left), len(runs)))
                digests.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(decoded(left))
                    gone.append(runs)
                if passages:
                    short.append(wordy(_runs(pb, pe, len(text))))
                    rest.append(decoded(_without(text, short[-1])))
            arrays = [*x.columns[5:], *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(digests, pa.string())]
            arrays += [as_runs(gone), pa.array(kept, pa.string())] * texts + [as_runs(short), pa.array(rest, pa.string())] * passages
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, length: int = 400, passage: int | None = None, least_words: int = 0, **options) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256. With
    ``keep`` (names of more columns, may be empty) also those, the runs that go (``removed``:
    begin and end in bytes), and the text that is left, by the name of the text column.

    With ``passage``, runs of strings of that many bytes that repeat are found too, and of
    these the ones with ``least_words`` words or more are given as ``passages``; the text
    that is left of them has the text column's name, that at ``length`` is ``kept_text``.
    Without it ``least_words`` holds for the runs at ``length``.

    Null counts as empty. Texts shorter than ``length`` bytes are left as they are; long
    ones are read in blocks. Of strings that repeat all go, there is no first that stays,
    so ties need no order. Rows that repeat an id and text are copies of each other, so all
    of both that lies in strings of ``length`` bytes goes; null ids are allowed. Columns not
    in ``keep`` are ignored. An empty table gives an empty result.
    """
    require(docs, id_col, text_col, *(keep or []))
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate([id_col, *(keep or [])])]
    rows = docs.select(F.col(text_col).alias("text"), *others)
    kinds = [f"{n} {t}" for n, t in rows.dtypes[1:]]
    packed = rows.mapInArrow(compress(["z", *rows.columns[1:]]), ", ".join(["z binary", *kinds]))
    packed = stage(packed.withColumn("row", F.monotonically_increasing_id()), "texts")
    texts, passages = keep is not None, passage is not None
    none = F.lit(None).cast("array<int>")
    if passages:
        if not texts or passage >= length:
            raise ValueError("passage must be less than length, and needs keep")
        short = stage(_gathered(repeated_spans(packed, passage, **options)), "passages")
        runs = packed.select("z", "row").join(short.hint("shuffle_hash"), "row").select("z", "row", "b", "e").mapInArrow(_runs_cut(length), "z binary, of long, begin int, size int")
        runs = stage(runs.withColumn("row", F.monotonically_increasing_id()), "runs")
        within = repeated_spans(runs, length, **options).join(runs.select("row", "of", "begin", "size"), "row")
        end = F.least("e", "size") + F.col("begin")
        spans = _gathered(within.select(F.col("of").alias("row"), (F.col("b") + F.col("begin")).alias("b"), end.alias("e")))
        spans = spans.join(short.select("row", F.col("b").alias("pb"), F.col("e").alias("pe")), "row", "full")
    else:
        spans = _gathered(repeated_spans(packed, length, **options)).withColumns({"pb": none, "pe": none})
    joined = packed.join(spans.hint("shuffle_hash"), "row", "left").select("z", "b", "e", "pb", "pe", *rows.columns[1:])
    more = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    more |= {"removed": "array<struct<begin:long,end:long>>", "kept_text": "string"} if texts else {}
    more |= {"passages": "array<struct<begin:long,end:long>>", "left_text": "string"} if passages else {}
    out = joined.mapInArrow(_removed([*rows.columns[1:], *more], texts, passages, least_words), ", ".join([*kinds, *(f"{n} {t}" for n, t in more.items())]))
    named = {"left_text" if passages else "kept_text": text_col}
    back = [F.col(n).alias(c) for n, c in zip(rows.columns[1:], [id_col, *(keep or [])])]
    return out.select(*back, *[F.col(n).alias(named.get(n, n)) for n in more])
