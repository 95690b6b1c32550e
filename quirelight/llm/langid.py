"""Language identification: word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to
its character n-grams, from the longest down to single characters: the first length
of which the model knows at least one gram decides, by the mean over those it knows.
Words are runs of letters (Unicode category L), lower-cased. The language with the
greatest sum over a text's words is predicted; the score is its share after softmax of
the mean word's scores, so that it doesn't saturate with length and a text of mixed
languages has a low one.

Frequencies are counted relationally over a bounded sample of the labelled rows
(``max_docs_per_lang`` rows and ``max_bytes_per_lang`` bytes, in expectation); every word
and n-gram of the sample is learned. A model is two arrays a table, 64-bit hashes and
frequencies, so that it takes a few bytes a word. Prediction reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, require, slices, stage

_ALNUM = re.compile(r"[^\W\d_]+")  # letters, and numbers such as ½ that str.isalpha tells apart
MOST_GRAM = 5
_CACHE = 200_000  # words whose scores a task keeps


def word_counts(text: str) -> Counter:
    found = Counter(_ALNUM.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between < and >; of a single character there are no bounds."""
    s = f"<{word}>" if n > 1 else word
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def _hashes(keys: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(k.encode("utf-8", "surrogatepass")) for k in keys), np.uint64, len(keys))


@dataclass
class Table:
    """Log frequencies by language, of keys in order of their hashes."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, wanted: list[str]) -> np.ndarray:
        """The row of each key, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        h = _hashes(wanted)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: list[Table]  # by length, from MOST_GRAM down to 1
    prior: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages); zeros where neither a word nor a character of it is known."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        at = self.words.find(words)
        out[at >= 0] = self.words.values[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n, table in zip(range(MOST_GRAM, 0, -1), self.grams):
            if not len(left):
                break
            each = [grams_of(words[i], n) for i in left]
            at = table.find([g for x in each for g in x])
            word = np.repeat(np.arange(len(left)), [len(x) for x in each])[at >= 0]
            known = np.bincount(word, minlength=len(left))
            total = np.zeros((len(left), len(self.langs)))
            np.add.at(total, word, table.values[at[at >= 0]])
            has = known > 0
            out[left[has]] = total[has] / known[has, None]
            left = left[~has]
        return out


def _table(counts: pa.Table, key: str, langs: list[str], smooth: float) -> Table:
    """counts: lang, key, n."""
    if not counts.num_rows:
        return Table(np.empty(0, np.uint64), np.zeros((0, len(langs)), np.float32))
    keys, place = np.unique(_hashes(counts[key].to_pylist()), return_inverse=True)
    lang = counts["lang"].combine_chunks().dictionary_encode()
    column = np.array([langs.index(x) for x in lang.dictionary.to_pylist()])
    cells = np.zeros((len(keys), len(langs)))
    np.add.at(cells, (place.ravel(), column[lang.indices.to_numpy()]), counts["n"].to_numpy())
    return Table(keys, np.log((cells + smooth) / (cells.sum(0) + smooth * (len(cells) + 1))).astype(np.float32))


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs_per_lang: int = 2000, max_bytes_per_lang: int = 8 << 20, smooth: float = 0.1) -> Model:
    """Fit on rows whose text and language are not null. Of a language with more than
    ``max_docs_per_lang`` rows or ``max_bytes_per_lang`` bytes, a sample by a hash of the id
    is taken, of that many in expectation. All that is in it is learned."""
    train = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = stage(train.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "languages")  # a row a language
    rows = {r["lang"]: r["n"] for r in sizes.select("lang", "n").collect()}
    langs = sorted(rows)
    if not langs:
        none = Table(np.empty(0, np.uint64), np.zeros((0, 0), np.float32))
        return Model([], none, [none] * MOST_GRAM, np.zeros(0))
    step = 1 << 30
    share = F.least(F.lit(1.0), F.lit(float(max_docs_per_lang)) / F.col("n"), F.lit(float(max_bytes_per_lang)) / F.greatest("bytes", F.lit(1)))
    sample = train.join(F.broadcast(sizes.select("lang", (share * step).cast("long").alias("upto"))), "lang").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(step)) < F.col("upto"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, 1024):
            by: dict[str, Counter] = {}
            for lang, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                by.setdefault(lang, Counter()).update(word_counts(text))
            for lang, c in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["lang", "word", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, 8192):
            by: Counter = Counter()
            for lang, word, n in zip(*(x.column(i).to_pylist() for i in range(3))):
                for k in range(1, MOST_GRAM + 1):
                    for g in grams_of(word, k):
                        by[lang, g, k] += n
            if by:
                lang, gram, size = zip(*by)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(size, pa.int32()), pa.array(by.values(), pa.int64())], ["lang", "gram", "k", "n"])

    words = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(words, "words")
    known = words.toArrow()  # of the sample, whose size is bounded
    grams = words.mapInArrow(spell, "lang string, gram string, k int, n long").groupBy("lang", "gram", "k").agg(F.sum("n").alias("n")).toArrow()
    release(words, sizes)
    tables = [_table(grams.filter(pc.equal(grams["k"], k)), "gram", langs, smooth) for k in range(MOST_GRAM, 0, -1)]
    total = np.array([rows[x] for x in langs], float)
    return Model(langs, _table(known, "word", langs, smooth), tables, np.log(total / total.sum()))


class Scorer:
    """Scores texts in one task; keeps the scores of words met, up to _CACHE."""

    def __init__(self, model: Model):
        self.model = model
        self.met: dict[str, int] = {}
        self.values = np.zeros((1024, len(model.langs)), np.float32)

    def _learn(self, words: list[str]) -> None:
        at, upto = len(self.met), len(self.met) + len(words)
        if upto > len(self.values):
            self.values = np.concatenate([self.values, np.zeros((max(upto - len(self.values), len(self.values)), self.values.shape[1]), np.float32)])
        self.values[at:upto] = self.model.scores(words)
        self.met.update(zip(words, range(at, upto)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        m, out = self.model, []
        counts = [word_counts(t or "") for t in texts]
        if not m.langs:
            return [("und", 0.0)] * len(texts)
        if len(self.met) > _CACHE:
            self.met, self.values = {}, self.values[:1024]
        if fresh := [w for w in dict.fromkeys(w for c in counts for w in c) if w not in self.met]:
            self._learn(fresh)
        for c in counts:
            if not c:
                out.append(("und", 0.0))
                continue
            number = np.fromiter(c.values(), float, len(c))
            total = m.prior + number @ self.values[np.fromiter(map(self.met.__getitem__, c), np.int64, len(c))]
            best = int(total.argmax())
            p = np.exp((total - total[best]) / number.sum())
            out.append((m.langs[best], float(1 / p.sum())))
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, the columns ``keep`` (name -> expression), lang_pred, score.

    lang_pred is a learned language; ``und`` with score 0 where the text is null, has no
    letter, or nothing was learned. Ties go to the first language by name. Repeated rows
    are predicted alike. Very long texts are read whole; a task holds a text and the counts
    of its words. Other columns are ignored. An empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a sample whose size is bounded
    keep = keep or {}
    names = [id_col, *keep, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for x in slices(batches):
            got = score(x.column(1).to_pylist())
            arrays = [x.column(0), *(x.column(i) for i in range(2, x.num_columns)), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    read = docs.select(F.col(id_col), F.col(text_col).alias("_text"), *[e.alias(k) for k, e in keep.items()])
    kinds = [f"`{n}` {t}" for n, t in read.dtypes if n != "_text"]
    return read.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows are not learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit_options) -> DataFrame:
    """Fit on the rows that aren't held out, predict all: id, held_out, lang_pred, score."""
    require(docs, id_col, text_col, lang_col)
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **fit_options)
    return predict(docs, model, id_col, text_col, {"held_out": held_out(id_col)})
