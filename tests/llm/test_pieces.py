"""Encoding and decoding by merges against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jambwork.llm import pieces, tokens
from tests.llm.helpers import rows

PATH = tokens.public("piece_bpe_32k.model")


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def check(texts: list[str]) -> None:
    own = pieces.pieces(PATH)
    for text, (data, agrees) in zip(texts, own.encode(texts), strict=True):
        want = own.library.encode(text, add_bos=True, add_eos=True)
        assert ids_of(data) == want and agrees
        assert own.decode(want) == own.library.decode(want)


@pytest.mark.parametrize("at", ["odd", "sf"])
def test_query(spark, request, at):
    folder = request.getfixturevalue(at)
    library = tokens.sentence_pieces(PATH)
    want = []
    for r in rows(folder, "documents"):
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    df = pieces.op13_sentencepiece(spark, folder)
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "agrees": "boolean"}
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["agrees"]) for r in df.collect()) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab ▁\n\t0é東京🙂<s>aeerrthin ÿß", max_size=400)), max_size=20))
def test_any_texts(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=12))
def test_any_ids_decode(ids):
    own = pieces.pieces(PATH)
    assert own.decode(ids) == own.library.decode(ids)


def test_awkward_texts():
    check(["", " ", "  ", "▁", "▁ a", " " * 500 + "x", "aaaa" * 500, "東京" * 400, "🙂" * 100, "\0a\0", " <0x0A></s><unk>", "a▁b", "the" * 90])


def test_small_caches_and_slices(monkeypatch):
    """The cache emptied again and again, texts cut into many slices, and heaps where rows would do: all the same."""
    r = random.Random(4)
    texts = ["".join(r.choice("ab the▁\n.,東é") for _ in range(r.randrange(0, 400))) for _ in range(120)]
    for short, cached, once in ((2, 50, 100), (64, 20, 37), (5, 10**6, 10**6)):
        for name, x in (("SHORT", short), ("CACHED", cached), ("AT_ONCE", once)):
            monkeypatch.setattr(pieces, name, x)
        pieces.pieces.cache_clear()
        check(texts)
    pieces.pieces.cache_clear()


def test_long_texts(spark):
    """Long runs without a place to cut, and a text of 12 MB."""
    check(["a" * 300_000, "ab" * 100_000, "東京都" * 100_000, "the quick brown fox, " * 600_000])


def test_disagreement_is_reported(monkeypatch):
    own = pieces.Pieces(PATH)
    monkeypatch.setattr(own, "agendas", lambda segments: [b"\1\0\0\0" for _ in segments])
    assert [x for _, x in own.encode(["some text", ""])] == [False, True]


def test_rows_without_ids(spark):
    df = pieces.encoded(spark.createDataFrame([(None, "a b"), (None, None), (3, "a b"), (3, "a b")], "doc_id long, text string"), PATH)
    assert sorted((r["doc_id"] or 0, len(r["ids"]) // 4) for r in df.collect()) == [(0, 2), (0, 4), (3, 4), (3, 4)]
