"""Katz backoff of any order against a plain recursion."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from jambwork.llm import katz
from tests.llm.conftest import prose

TEXTS = [*(" ".join(w[:3] for w in prose(i, 60).split()) for i in range(12)), "a b c a b d a b c", "a b", "", None]


def plain(texts: list[list], train: list[bool], order: int):
    """p(word, history) of a Katz model, and its histories."""
    start = lambda ws: ["<s>", *ws]
    counts = [Counter() for _ in range(order + 1)]
    for ws, own in zip(texts, train, strict=True):
        for k in range(1, order + 1):
            for i in range(len(ws)) if own else ():
                if i >= k - 2:
                    counts[k][tuple(start(ws)[i + 2 - k : i + 2])] += 1

    def discount(c):
        t = Counter(c.values())
        last, d = (6 * t[6] / t[1] if t[1] else 1), {}
        for r in range(1, 6):
            x = ((r + 1) * t[r + 1] / (r * t[r]) - last) / (1 - last) if t[r] and last < 1 else 1
            d[r] = x if 0 < x < 1 else 1
        return lambda k: k * d.get(k, 1)

    of, n, v = [discount(c) for c in counts], sum(counts[1].values()), len(counts[1])
    rest = 1 - sum(of[1](c) for c in counts[1].values()) / n
    after = defaultdict(list)
    for k in range(2, order + 1):
        for g in counts[k]:
            after[g[:-1]].append(g[-1])

    def p(w, h):
        if not h:
            c = counts[1][(w,)]
            return (c + 1) / (n + v + 1) if rest < 1e-12 else of[1](c) / n if c else rest
        c, d = counts[len(h) + 1], of[len(h) + 1]
        total, kept = (sum(f(c[(*h, x)]) for x in after[h]) for f in (lambda k: k, d))
        if not total:
            return p(w, h[1:])
        none = total - kept < 1e-9 * total
        if (*h, w) in c:
            return d(c[(*h, w)]) / (total + none)
        left = 1 / (total + 1) if none else (total - kept) / total
        return left / (1 - sum(p(x, h[1:]) for x in after[h])) * p(w, h[1:])

    return p, after, [w for (w,) in counts[1]]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("hot", [500, 10**9])
def test_orders(spark, monkeypatch, order, hot):
    """Each order falls back on the one below; with all histories spread over the table's parts, too."""
    monkeypatch.setattr(katz, "HOT", hot)
    train = [i % 4 != 2 for i in range(len(TEXTS))]
    words = [[*(t or "").lower().split(), None] for t in TEXTS]
    p, after, known = plain(words, train, order)
    for h in [*after][:: max(1, len(after) // 15)]:
        assert sum(p(w, h) for w in [*known, "<unknown>"]) == pytest.approx(1, abs=1e-9)
    docs = spark.createDataFrame([(i, t, own) for i, (t, own) in enumerate(zip(TEXTS, train, strict=True))], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r["score"] for r in katz.score(docs, order=order).collect()}
    for i, ws in enumerate(words):
        line = ["<s>", *ws]
        want = sum(math.log10(p(w, tuple(line[max(0, j + 2 - order) : j + 1]) if order > 1 else ())) for j, w in enumerate(ws))
        assert got[i] == pytest.approx(want, rel=1e-9)
