"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file: the normaliser (a space becomes U+2581, one is put before a
text), the pieces (a trie of arcs that read a piece and write its id), and byte fallback
(an arc for a character without a piece, which writes the ids of its bytes). An input,
an acyclic chain of characters, is composed with it on the fly, and the path of least
weight in the tropical semiring (min, +) is taken.

Unigram models: an arc weighs minus its piece's score; one state is enough.

BPE models: a state is the last symbol, and an arc exists only where merging could not
have crossed the seam: two symbols may follow one another if and only if merging their
joined text gives just these two. Merges inside symbols never look across a seam, so a
path of such arcs is what merging yields for the text, and there is exactly one for it
and for each of its beginnings; all other paths weigh infinity. Results equal those of
merging by score, the leftmost pair first.

No piece has U+2581 after another character, so words (with the spaces before them) are
composed one by one, and a task remembers words. Where a model has such pieces, a whole
text is one word.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
_WORDS = 600_000  # words that a worker remembers
_NONE = ({}, None)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Transducer:
    def __init__(self, model: bytes):
        """model: the bytes of a ModelProto. Field numbers are those of the public schema."""
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.prefix, self.squeeze = UNIGRAM, False, True, True
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                self.kind, self.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
                if f.get(24):
                    raise ValueError("models with spaces as suffixes are not supported")
            elif number == 3:
                f = dict(_fields(value))
                self.prefix, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
                if f.get(2) or not f.get(5, 1):
                    raise ValueError("only the identity normaliser with escaped spaces is supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(t == USER for _, _, t in self.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.scores = {p: s for p, s, t in self.pieces if t == NORMAL}
        self.bytes = [0] * 256
        for i, (p, _, t) in enumerate(self.pieces):
            if t == BYTE:
                self.bytes[int(p[3:-1], 16)] = i
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.trie: dict[str, list] = {}  # character -> [what may come next, the piece that ends here or None]
        self.follows: dict[tuple[str, str], bool] = {}
        for p in self.ids:
            if self.kind == BPE and len(p) > 1 and self._merged(p) != [p]:
                continue  # never comes out of merging
            kids = self.trie
            for c in p:
                node = kids.setdefault(c, [{}, None])
                kids = node[0]
            node[1] = p
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r".+", re.S)
        self.penalty = 10.0 - min(self.scores.values(), default=0.0)
        self.out = [self._decoded(p, t) for p, _, t in self.pieces]

    def __reduce__(self):
        raise TypeError("send the model's bytes and compile them where they are used")

    @staticmethod
    def _decoded(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def _merged(self, text: str) -> list[str]:
        """Merging by score, the leftmost pair first. For the short texts of seams."""
        symbols = list(text)
        while True:
            best = max(((s, -i) for i in range(len(symbols) - 1) if (s := self.scores.get(symbols[i] + symbols[i + 1])) is not None), default=None)
            if best is None:
                return symbols
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether merging leaves the seam alone: nothing that ends a meets what begins b
        sooner than both are complete."""
        return self._merged(a + b) == [a, b]

    def _arcs(self, text: str, at: int) -> list[str]:
        """Symbols that can be read: pieces, and the single character."""
        found, kids = [], self.trie
        for c in text[at:]:
            if c not in kids:
                break
            kids, symbol = kids[c]
            if symbol is not None:
                found.append(symbol)
        if text[at] not in found:
            found.append(text[at])
        return found

    def shortest_path(self, text: str) -> list[str]:
        """The symbols along the path of least weight."""
        into = self._merging(text) if self.kind == BPE else self._unigram(text)
        at, path = len(text), []
        while at:
            path.append(into[at])
            at -= len(into[at])
        return path[::-1]

    def _unigram(self, text: str) -> list:
        """The last symbol of the best path to each position."""
        weight, into = [0.0] + [float("inf")] * len(text), [None] * (len(text) + 1)
        for at in range(len(text)):
            for symbol in self._arcs(text, at):
                w = weight[at] - self.scores[symbol] if symbol in self.scores else weight[at] + self.penalty
                if w < weight[at + len(symbol)]:
                    weight[at + len(symbol)], into[at + len(symbol)] = w, symbol
        return into

    def _merging(self, text: str) -> list:
        """The same for merges. One path leads to each position, that of the text up to it,
        so that a position has one state: what is found first is the least."""
        into: list = [None] * (len(text) + 1)
        follows, trie, n = self.follows, self.trie, len(text)
        known = follows.get
        for at in range(n):
            state = into[at]
            if state is None and at:
                continue
            kids, end = trie, at
            while end < n:
                node = kids.get(text[end])
                if node is None:
                    break
                end += 1
                kids, symbol = node
                if symbol is not None and into[end] is None:
                    if at:
                        ok = known((state, symbol))
                        if ok is None:
                            if len(follows) >= 1 << 20:
                                follows.clear()
                            ok = follows[state, symbol] = self.may_follow(state, symbol)
                        if ok:
                            into[end] = symbol
                    else:
                        into[end] = symbol
                if not kids:
                    break
            if into[at + 1] is None and trie.get(text[at], _NONE)[1] is None and (not at or self.may_follow(state, text[at])):
                into[at + 1] = text[at]  # a character that is no piece
        return into

    def ids_of(self, word: str) -> list[int]:
        out: list[int] = []
        for s in self.shortest_path(word):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return [i for w in self.word.findall(self.normalise(text)) for i in self.ids_of(w)]

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Remembered(dict):
    """word -> its ids as 32-bit numbers."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst = fst

    def __missing__(self, word: str) -> bytes:
        got = np.array(self.fst.ids_of(word), np.int32).tobytes()
        if len(word) <= 20:  # longer ones seldom come again
            if len(self) >= _WORDS:
                self.clear()
            self[word] = got
        return got


@lru_cache(2)
def _compiled(model: bytes) -> _Remembered:
    """Once for each Python worker."""
    return _Remembered(Transducer(model))


def read_model(path: str) -> bytes:
    """The model file's bytes, read on the driver; a vocabulary, so of bounded size."""
    return Path(path).read_bytes()


def encode_table(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (array of int), n_pieces, round_trip.

    round_trip: decoding ids gives the text again, up to normalisation. Null counts as
    empty, which has no pieces. Null and repeated ids keep their rows. Other columns are
    ignored. An empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _compiled(shared.value)
        fst = words.fst
        find, get = fst.word.findall, words.__getitem__
        for x in batches:
            for at in range(0, x.num_rows, 512):
                part = x.slice(at, 512)
                flat, same = [], []
                for text in part.column(1).to_pylist():
                    norm = fst.normalise(text or "")
                    ids = np.frombuffer(b"".join(map(get, find(norm))), np.int32)
                    flat.append(ids)
                    same.append(fst.decode(ids.tolist()) == norm[1 if fst.prefix else 0 :].replace(SPACE, " "))
                sizes = np.array([len(i) for i in flat], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes), pa.array(same)], [id_col, "ids", "n_pieces", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_pieces int, round_trip boolean")


def decode_table(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id, text. Null ids give an empty text; ids outside the vocabulary raise."""
    require(encoded, id_col, ids_col)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(shared.value).fst
        for x in batches:
            texts = [fst.decode(ids or ()) for ids in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, F.col(ids_col).alias("_ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")
