"""The class models of toxicity against a plain version, and their sums."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from jambwork.llm import kernels as K
from jambwork.llm import toxicity

BAD, COMMON = "vile scum filth rot".split(), "the of and river stone light quiet engine sailor copper window garden winter".split()


def sample() -> list[tuple[int, str, int]]:
    r = random.Random(4)
    words = lambda own: [r.choice(own) if r.random() < 0.2 else r.choice(COMMON) for _ in range(r.randrange(5, 40))]
    rows = [(i, " ".join(words(BAD if i % 3 == 0 else ["plain", "calm"])), int(i % 3 == 0)) for i in range(240)]
    return [*rows, *((1000 + i, rows[0][1], 1) for i in range(30)), (2000, "", 0), (2001, None, 1)]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([r[:2] for r in sample()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in sample()], "doc_id long, toxic int")
    return toxicity.train(docs, labels, held_out=None)


def flat(texts: list[str]) -> K.Words:
    b = [t.encode() for t in texts]
    return K.Words(np.frombuffer(b"".join(b), np.uint8), np.append(0, np.cumsum([*map(len, b)])))


def test_each_history_sums_to_one(model):
    unknown = np.uint64(12345)
    assert not (model.words == unknown).any()
    w = np.append(model.words, unknown)
    for h in [*model.hists[:40], unknown]:
        assert model.probabilities(np.full(len(w), h), w).sum(0) == pytest.approx([1, 1])


def test_probabilities_are_those_of_a_plain_version(spark, model):
    part = {r["doc_id"]: r["fit"] for r in spark.createDataFrame([(r[0],) for r in sample()], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 1), 3) = 0 AS fit").collect()}
    texts = {(t or "", y) for i, t, y in sample() if not part[i]}
    c = defaultdict(lambda: [0, 0])
    for t, y in texts:
        for p in {*zip(["<s>", *t.split()], t.split(), strict=False)}:
            c[p][y] += 1
    total, ones, twos = np.sum([*c.values()], 0), sum(sum(x) == 1 for x in c.values()), sum(sum(x) == 2 for x in c.values())
    types = np.array([sum(x[0] > 0 for x in c.values()), sum(x[1] > 0 for x in c.values()), len(c)], float)
    d = ones / max(ones + 2 * twos, 1)
    word, hist = defaultdict(lambda: np.zeros(5)), defaultdict(lambda: np.zeros(2))
    for (h, w), x in c.items():
        word[w] += [*x, 1, x[0] > 0, x[1] > 0]
        hist[h] += x
    kept = {w: x for w, x in word.items() if x[0] + x[1] >= toxicity.LEAST}
    over = lambda n, e, both: max(n - e - toxicity.SHARE * max(both - e, 0) - toxicity.ERRORS * e**0.5, 0)
    continued = {w: max(x[2] - d, 0) / types[2] for w, x in kept.items()}
    beyond = {w: [min(over(x[k], (x[0] + x[1]) * total[k] / total.sum(), x[0] + x[1]) / total[k], over(x[3 + k], x[2] * types[k] / types[2], x[2]) / types[k]) for k in (0, 1)] for w, x in kept.items()}
    p1 = lambda w, k: beyond[w][k] + (1 - sum(x[k] for x in beyond.values())) * continued[w]
    pairs = {p: x for p, x in c.items() if sum(x) >= toxicity.LEAST}

    def p(h, w, k):
        direct = lambda v: max(sum(pairs.get((h, v), [0, 0])) - d, 0) / hist[h].sum()
        back = 1 - sum(direct(v) for v in kept)
        shared = lambda v: direct(v) + back * p1(v, k)
        own = lambda v: over(pairs[h, v][k], hist[h][k] * shared(v), sum(pairs[h, v])) / (hist[h][k] + toxicity.STRENGTH) if (h, v) in pairs else 0
        return own(w) + (1 - sum(own(v) for v in kept)) * shared(w)

    assert len(model.words) == len(kept) and "scum" in kept and Counter(h for h, _ in pairs)
    for h, w in [("the", "scum"), ("scum", "the"), ("vile", "rot"), ("and", "river"), ("calm", "plain")]:
        a, b = flat([h]).hashes(), flat([w]).hashes()
        assert model.probabilities(a, b)[0] == pytest.approx([p(h, w, 0), p(h, w, 1)])
