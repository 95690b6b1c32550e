import struct
from itertools import combinations
from pathlib import Path

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from quirelight.llm.queries import TOKENIZER
from quirelight.llm.sentencepiece_fst import SPACE, Transducer, decode_table, encode_table, read_model

pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no model file")
TEXTS = ["", " ", "a", "Hello  world", " lead", "trail ", "É\n\t naïve 梦 \U0001f600 x", "aaaaaaaaaaaaaaaa" * 40, " " * 100 + "x", "thathen inging errere 12345.678", "a▁b", "é \x00 \x7f", "don't <s> </s> <unk> <0x41>", "　\xa0"]


@pytest.fixture(scope="module")
def both():
    return Transducer(read_model(TOKENIZER)), sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(both, text):
    assert both[0].encode(text) == both[1].encode(text)
    assert both[0].decode(both[0].encode(text)) == text.replace(SPACE, " ")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("theraniogds é1. \n梦"), max_size=60))
def test_random_texts(both, text):
    assert both[0].encode(text) == both[1].encode(text)


def field(number, kind, value):
    return bytes([number << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)


def test_unigram_takes_the_least_weight():
    pieces = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -1.0, "aba": -3.2, SPACE: -1.5, f"{SPACE}a": -2.2}
    raw = field(1, 2, field(1, 2, b"<unk>") + field(3, 0, b"\x02"))
    for p, s in pieces.items():
        raw += field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)))
    raw += field(3, 2, field(4, 0, b"\x00"))
    fst = Transducer(raw)
    for text in ("abab", "baab", "a", "bbaba", "abbaabab"):
        norm = fst.normalise(text)
        cuts = [c for k in range(len(norm)) for c in combinations(range(1, len(norm)), k)]
        ways = [[norm[a:b] for a, b in zip((0, *c), (*c, len(norm)))] for c in cuts]
        best = min(sum(-fst.scores[p] for p in w) for w in ways if all(p in fst.scores for p in w))
        assert abs(sum(-fst.pieces[i][1] for i in fst.encode(text)) - best) < 1e-6


def test_tables(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x"), (None, "word " * 30000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    model = read_model(TOKENIZER)
    out = encode_table(df, model)
    got = sorted(((str(r["doc_id"]), r["ids"], r["n_pieces"]) for r in out.collect()))
    assert got == sorted((str(i), ids, len(ids)) for i, t, _ in rows for ids in [lib.encode(t or "")])
    assert all(r["round_trip"] for r in out.collect())
    back = sorted((str(r["doc_id"]), r["text"]) for r in decode_table(out, model).collect())
    assert back == sorted((str(i), (t or "").replace(SPACE, " ")) for i, t, _ in rows)
    assert encode_table(df.where("false"), model).collect() == []
