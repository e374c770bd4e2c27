"""The five stages of the pipeline against plain versions, with repeated rows and null ids."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from jambwork.llm import jaccard, mixing, packing, suffixes, tokens, toxicity
from jambwork.llm import kernels as K
from tests.llm.conftest import prose
from tests.llm.helpers import WORD, cut, shingles, write

NAMES = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near(text: str, at: int = 40) -> str:
    words = text.split()
    words[at] = "changed"
    return " ".join(words)


def documents() -> list[tuple]:
    a, b, c, d, e = (prose(i, 120) for i in range(90, 95))
    texts = [(5, a), (5, a), (9, near(a)), (7, b), (7, b), (7, b)]  # repeated rows, alone and with a near copy
    texts += [(None, c), (None, near(c)), (None, near(c, 90)), (None, d), (None, d), (3, near(e)), (None, e), (None, e)]  # groups without an id, and with one id
    texts += [(None, ""), (None, ""), (None, None), (11, ""), (11, prose(95, 60)), (12, " "), (12, " "), (13, None)]
    texts += [(20, prose(96, 50)), (20, prose(97, 50)), (None, "three words here"), (8, "Three WORDS here"), (21, d[:300] + " tail of its own"), (22, prose(98, 70) + d[200:500])]
    texts += [(30 + i, prose(200 + i, 30 + i)) for i in range(30)]
    return [(i, t, "en", ("web", "books", None)[k // 3 % 3], len(t or "")) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repeats")
    write(root, "documents", documents(), SCHEMA)
    return spark.read.parquet(f"{root}/documents.parquet").repartition(5)


def after(stage, spark, docs) -> list[tuple]:
    return [tuple(r[x] for x in NAMES) for r in stage(spark, docs, "").collect()]


def groups(rows: list[tuple]) -> list[list[tuple]]:
    """Rows that are linked by their sets, by an id, or as equal rows, by comparing all pairs."""
    sets, root = [shingles(r[1]) for r in rows], [*range(len(rows))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (x, r) in enumerate(zip(sets, rows, strict=True)):
        for j in range(i):
            both = len(x & sets[j])
            if r == rows[j] or (r[0] is not None and r[0] == rows[j][0]) or (x and sets[j] and 100 * both >= 80 * (len(x) + len(sets[j]) - both)):
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i, r in enumerate(rows):
        out[find(i)].append(r)
    return [*out.values()]


def test_one_row_of_each_group_stays(spark, docs):
    got = after(jaccard.stage, spark, docs)
    want = groups(documents())
    assert len(got) == len(want)
    for g in want:
        kept = [r for r in got if r in g]
        assert len(kept) == 1 and kept[0][0] == min((r[0] for r in g if r[0] is not None), default=None)


def test_components_of_null_ids(spark, docs):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect())
    assert got == Counter((r[0], len(shingles(r[1])), min((x[0] for x in g if x[0] is not None), default=None)) for g in groups(documents()) for r in g)


def test_repeated_bytes_go(spark, docs):
    kept = cut([(r[1] or "").encode() for r in documents()])
    want = [(r[0], k.decode("utf-8", "replace").replace("�", "")) for r, (k, _, _) in zip(documents(), kept, strict=True)]
    got = after(suffixes.stage, spark, docs)
    assert Counter((r[0], r[1]) for r in got) == Counter(want) and all(r[4] == len(r[1]) for r in got)


def test_rows_come_as_often_as_the_mix_takes_them(spark, docs):
    rows = documents()
    size = lambda r: len(WORD.findall(r[1] or ""))
    target = {r["doc_id"]: (r["source_size"], math.floor(r["target"])) for r in mixing.mix(docs).collect()}
    want = Counter()
    for s in {r[3] for r in rows}:
        own, before = [r for r in rows if r[3] == s], 0
        whole = sum(map(size, own))
        words = next(target[r[0]][1] for r in own if r[0] is not None and r[0] >= 30)
        for r in sorted(own, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest() if r[0] is not None else "", r[0] or 0, size(r))):
            n = size(r)
            if n:
                want[r[0], s, n] += math.floor((words // whole * n + max(0, min(n, words % whole - before))) / n + 0.5)
            before += n
    got = after(mixing.stage, spark, docs)
    assert Counter((r[0], r[3], size(r)) for r in got) == +want
    assert {*got} <= {*rows} and any(r[0] is None for r in got)


def test_all_tokens_are_packed(spark, docs):
    encode, want, got = tokens.byte_pairs(tokens.public("byte_bpe_50k.json")), Counter(), Counter()
    for r in documents():
        want[r[0]] += len(encode([r[1] or ""])[0]) + 1
    for p in packing.stage(spark, docs, "").collect():
        got[p["doc_id"]] += p["length"]
    assert got == want


def test_rows_that_are_not_toxic_stay(spark, tmp_path):
    r = random.Random(1)
    bad = [" ".join(r.choice("vile scum filth rot vermin the of and".split()) for _ in range(40)) for _ in range(60)]
    good = [prose(400 + i, 40) for i in range(60)]
    rows = [(1000 + i, t, "en", "web", len(t)) for i, t in enumerate(bad + good)] + documents()
    rows += [(None, bad[0], "en", "web", 1), (None, bad[0], "en", "web", 1), (1000, bad[0], "en", "web", len(bad[0]))]
    write(tmp_path, "documents", rows, SCHEMA)
    write(tmp_path, "labels", [(1000 + i, 1, int(i < 60)) for i in range(120)], "doc_id long, quality int, toxic int")
    df, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.train(df, labels)
    toxic = lambda t: model.score(K.Words(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])))[0] >= 0.5
    got = [tuple(r[x] for x in NAMES) for r in toxicity.stage(spark, df, str(tmp_path)).collect()]
    assert Counter(got) == Counter(r for r in rows if not toxic(r[1]))
    assert not {x[1] for x in got} & {*bad} and Counter(got)[documents()[0]] == 2


def test_repeated_rows_and_null_ids_reach_the_end(spark, tmp_path):
    rows = [(*r[:3], "web", r[4]) for r in documents()]  # of one source the mix takes all words
    write(tmp_path, "documents", rows, SCHEMA)
    write(tmp_path, "labels", [], "doc_id long, quality int, toxic int")
    got = {p["doc_id"] for p in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    worded = [g for g in groups(rows) if any(shingles(r[1]) for r in g)]
    assert {5, 7, None} <= got <= {min((r[0] for r in g if r[0] is not None), default=None) for g in worded}
