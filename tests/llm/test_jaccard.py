"""The Jaccard join against all pairs: other thresholds, families of alike texts, frequent tokens, long texts."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from jambwork.llm import jaccard
from tests.llm.conftest import WORDS, prose
from tests.llm.helpers import linked, shingles


def families(seed: int) -> list[tuple[int, str]]:
    """Texts that share passages to all degrees, some of them in most texts."""
    r = random.Random(seed)
    common = prose(seed, 25)
    out = []
    for f in range(6):
        base = prose(100 * seed + f, r.choice([12, 40, 120])).split()
        for k in range(9):
            words = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 5, 12])):
                words[r.randrange(len(words))] = r.choice(WORDS) + str(r.randrange(9))
            text = " ".join(words[: r.randrange(len(words) // 2, len(words) + 1)] if k % 4 == 3 else words)
            out.append((1000 * f + k, (common + " " + text) if k % 2 else text))
    r.shuffle(out)
    return [*out, (5000, ""), (5001, None), (5002, "one two"), (5003, "ONE two"), (5004, prose(3, 60_000)), (5005, prose(3, 60_000) + " end")]


@pytest.mark.parametrize(("percent", "full", "rounds"), [(80, 1024, 2), (50, 1024, 1), (60, 1, 2), (100, 6, 0)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, percent, full, rounds):
    monkeypatch.setattr(jaccard, "FULL", full)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "PAIRS", 0)
    docs = families(percent)
    got = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), percent=percent).collect()
    root = linked(docs, percent)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((d, len(shingles(t)), root[d]) for d, t in docs)


def test_lower_thresholds_link_sets_of_unlike_size(spark):
    a = prose(1, 104)
    b = " ".join(a.split()[:64])
    got = jaccard.join(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), percent=50).collect()
    assert {r["component_id"] for r in got} == {1}


def test_a_group_of_alike_sets_takes_no_square_of_pairs(spark, monkeypatch):
    """Sets of one group of which each links with some others only, beside a class that has most of them."""
    r, base, made = random.Random(5), prose(9, 150).split(), []
    docs = [(k, " ".join(r.choice(WORDS) + str(r.randrange(9)) if i in own else w for i, w in enumerate(base))) for k in range(600) if (own := {r.randrange(150) for _ in range(2)})]
    verified = jaccard._verified

    def counted(pairs, *more):
        made.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", counted)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    got = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    root = linked(docs, 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: root[d] for d, _ in docs}
    assert sum(made) < 10 * len(docs)


@pytest.mark.parametrize("many", [0.0, 1.0, 3.9, 4.1, 77.0, 1e7])
def test_shares_of_pairs_are_all_of_them_once(many):
    shares = jaccard._shares(many)
    assert [low for low, _, _ in shares] == [0, *(high for _, high, _ in shares[:-1])] and shares[-1][1] == shares[-1][2] + 1
    assert shares[0][1] * many <= max(many, shares[-1][1])
