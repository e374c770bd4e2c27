"""Ranked lexical search against all scores, whatever the thresholds and blocks."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from jambwork.llm import search
from tests.llm.helpers import lower, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    held = [(d, c) for d, t in docs if (c := Counter(TERM.findall(lower(t or ""))))]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text or "")) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("at", ["odd", "sf"])
def test_query(spark, request, at):
    folder = request.getfixturevalue(at)
    pairs = lambda name, key: [(r[key], r["text"]) for r in rows(folder, name)]
    df = search.op12_lexical_search(spark, folder)
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert got(df) == plain(pairs("documents", "doc_id"), pairs("benchmark", "item_id"), 20)


@pytest.mark.parametrize("k", [1, 3])
def test_blocks_and_thresholds(spark, monkeypatch, k):
    """Items in many blocks, documents a few at a time, so that thresholds rise and prune; many ties."""
    monkeypatch.setattr(search, "TERMS_AT_ONCE", 40)
    monkeypatch.setattr(search, "DOCS_AT_ONCE", 7)
    r = np.random.default_rng(5)
    word = lambda: f"w{int(r.zipf(1.3)) % 60}"
    docs = [(int(r.integers(0, 150)) if i % 11 else None, " ".join(word() for _ in range(int(r.integers(0, 40))))) for i in range(200)]
    docs += docs[:20] + [(900, "w1 " * 3000)]
    items = [(i, " ".join(word() for _ in range(int(r.integers(1, 25))))) for i in range(12)]
    frame = lambda x, key: spark.createDataFrame(x, f"{key} long, text string")
    assert got(search.top(frame(docs, "doc_id"), frame(items, "item_id"), k)) == plain(docs, items, k)


def test_prunes(spark):
    """With a high seed, common terms are not asked for."""
    terms, weights = np.array([0, 1]), np.array([10, 1])
    scorer = search.Scorer([(terms, weights, np.array([110, 10, 0]), 50)], 1, 2)
    pack = lambda *x: np.array(x, "<u4").tobytes()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "n": [2, 1, 1], "terms": [pack(0, 1), pack(1), pack(0)], "times": [pack(1, 1), pack(1), pack(1)]})
    scorer.add(batch, 3, 4)
    assert [scorer.ids[i] for i in scorer.best[0][1]] == [3] and scorer.floor[0] > 50


def test_long_text(spark):
    """A text of 20 MB among short ones."""
    text = "alpha beta " * 1_800_000
    docs = [(1, text), (2, "alpha"), (3, "gamma")]
    items = [(1, "alpha gamma")]
    frame = lambda x, key: spark.createDataFrame(x, f"{key} long, text string")
    assert got(search.top(frame(docs, "doc_id"), frame(items, "item_id"))) == plain(docs, items, 20)
