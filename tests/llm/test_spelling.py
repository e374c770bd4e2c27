"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from jambwork.llm import spelling
from tests.llm.helpers import lower, rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(docs: list[tuple], shortest: int = 5, least: int = 3) -> dict[str, int]:
    c: Counter = Counter()
    for d, t in docs:
        for w in map(lower, RUN.findall(t or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= shortest and n >= least}


def one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words: dict[str, int]) -> list[tuple]:
    form, near = {}, {}
    for w, n in words.items():
        at = [x for x in words if abs(len(x) - len(w)) < 2 and one(x, w)]
        best = min(at, key=lambda x: (-words[x], x), default=None)
        near[w], form[w] = len(at), best if best is not None and words[best] >= 2 * n else None
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, near[w], form[w] and words[form[w]]) for w, n in words.items())


def got(df) -> list[tuple]:
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


@pytest.mark.parametrize("at", ["odd", "sf"])
def test_query(spark, request, at):
    folder = request.getfixturevalue(at)
    df = spelling.op11_spelling_variants(spark, folder)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    words = counts([(r["doc_id"], r["text"]) for r in rows(folder, "documents")])
    if at == "sf":  # pairs by what a deletion leaves, as all pairs would take long here
        assert {r[0]: r[3] for r in got(df)} == words
        words = {w: n for w, n in words.items() if w[0] in "aü"}
        df = spelling.variants(spark.createDataFrame([*words.items()], "word string, n long"))
    assert got(df) == plain(words)


@pytest.mark.parametrize(("depth", "shard", "room"), [(250, 100_000, 1 << 20), (3, 17, 3000)])
def test_depths_shards_and_rounds(spark, monkeypatch, depth, shard, room):
    """Any depth of the tries, size of the shards and of the rounds gives the same."""
    for name, x in (("DEPTH", depth), ("SHARD_WORDS", shard), ("ROUND_BYTES", room), ("AT_ONCE", 50)):
        monkeypatch.setattr(spelling, name, x)
    r = random.Random(3)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 7))): r.randrange(1, 40) for _ in range(250)}
    words |= {"a" * 300: 9, "a" * 301: 20, "a" * 299 + "b": 4, "ÿ" * 260: 3}
    monkeypatch.setattr(spelling, "build", lambda w, n, f=spelling.build, d=depth: (setattr(spelling, "DEPTH", d), f(w, n))[1])
    rows_ = [*words.items(), (None, 5)]
    assert got(spelling.variants(spark.createDataFrame(rows_, "word string, n long"))) == plain(words)


@pytest.mark.parametrize("depth", [250, 4])
def test_tries(monkeypatch, depth):
    monkeypatch.setattr(spelling, "DEPTH", depth)
    r = random.Random(2)
    for _ in range(40):
        letters = r.choice(["ab", "abcé", "abcdefgzÀÿ"])
        some = lambda n: sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(n)})  # noqa: B023, E731
        words, asked = some(r.choice([1, 5, 200])), some(60)
        trie = spelling.Shard(spelling.build(words, np.arange(len(words))))
        w, k = trie.near(asked)
        assert sorted((asked[a], words[b]) for a, b in zip(w.tolist(), k.tolist(), strict=True)) == sorted((a, b) for a in asked for b in words if a != b and one(a, b))


def test_repeated_words_add_up(spark):
    assert got(spelling.variants(spark.createDataFrame([("abcde", 2), ("abcde", 3), ("abcd", 1)], "word string, n long"))) == [("abcd", "abcde", "abcde", 1, 1, 5), ("abcde", None, "abcde", 5, 1, None)]


def test_other_letters_are_refused():
    with pytest.raises(ValueError, match="letters"):
        spelling.build(["ab1"], np.ones(1, int))


def test_long_texts_and_runs(spark):
    """A run of two million letters, and a text of 20 MB."""
    docs = [(i, "z" * 2_000_000 + " Stone stone") for i in range(3)] + [(9, "Lantern lanterns " * 1_200_000), (None, None), (7, "")]
    df = spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string"), shortest=5, spoil=97)
    assert {r["word"]: r["n"] for r in df.where("n >= 3").collect()} == counts(docs)
