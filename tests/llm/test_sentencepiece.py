"""Piece ids against the sentencepiece library, and exact round trips."""

import random

import numpy as np
import pytest
from corpusmill.llm import sentencepiece_codec as codec

sentencepiece = pytest.importorskip("sentencepiece")


def texts():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäéñ ßTHE,.!?0123 \n\t▁   "
    out = ["", None, " ", "  a   b\n\n  c", "x" * 200, "日本語 テスト 😀é́", "\x00\x01 tab\tz", " " * 70, "a" + " " * 37 + "b", "the the the", "▁▁ a ▁"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(200)]
    long = ["".join(rng.choice("abcdeé") for _ in range(20_000)), "ab" * 10_000 + " tail"]  # single words
    return out + long + ["the quick brown fox " * 500, out[20], out[20]]


def test_ids_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(codec, "CACHE", 50)
    model = codec.load_model()
    library = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    encoder = codec.Encoder(model)
    rows = texts()
    for at in range(0, len(rows), 40):
        for text, ids in zip(rows[at : at + 40], encoder.encode(rows[at : at + 40]), strict=True):
            assert (ids is None) if text is None else ids.tolist() == library.encode(text)


def test_round_trip(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens int")
    model = codec.broadcast_model(spark)
    got = codec.encoded(df, model, check=True).withColumn("back", codec.decoded("input_ids", model)).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    for r in got:
        assert r.back == (None if r.text is None else r.text.replace("▁", " "))
        assert r.n_tokens == len(r.input_ids or [])
    assert codec.encoded(df.limit(0), model).count() == 0
