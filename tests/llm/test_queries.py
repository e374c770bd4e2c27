"""Each numbered query against a plain version, on awkward rows and on the smallest tables."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from jambwork.llm import queries, tokens
from tests.llm.helpers import WORD, base_counts, cut, linked, lower, rows, shingles

BOTH = ["odd", "sf"]


@pytest.fixture(params=BOTH)
def folder(request):
    return request.getfixturevalue(request.param)


def run(spark, name: str, folder: str) -> list[dict]:
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


@pytest.mark.parametrize("name", [*queries.QUERIES])
def test_without_rows(spark, nothing, name):
    assert run(spark, name, nothing) == []


@pytest.mark.parametrize("name", [*queries.ORACLE_SQL])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    key = lambda r: tuple(str(round(r[c], 6) if isinstance(r[c], float) else r[c]) for c in sorted(cols))
    assert sorted(map(key, run(spark, name, sf))) == sorted(key(dict(zip(cols, r, strict=True))) for r in want.fetchall())


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.public("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], tuple([*tokens.byte_pairs(tokens.public("byte_bpe_50k.json"))([r["text"] or ""])[0], 0])) for r in rows(folder, "documents"))
    plain = [r["text"] for r in rows(folder, "documents") if r["text"] and "<|" not in r["text"]]
    assert all(own.encode(t, add_special_tokens=False).ids == tokens.byte_pairs(tokens.public("byte_bpe_50k.json"))([t])[0] for t in plain[:40])
    got = run(spark, "op1_packing", folder)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for p in got:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        pieces[p["doc_id"]].append(p)
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
        assert 0 < sum(n for _, n in s) <= 1024
    total = sum(len(ids) for (_, ids), n in want.items() for _ in range(n))
    used = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(used) == total
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in used) <= 0.02 * total
    for (doc, ids), n in want.items():
        if sum(k for (d, _), k in want.items() if d == doc) == n == 1:
            own = sorted(pieces[doc], key=lambda p: p["start"])
            assert [p["start"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
            assert sum(p["length"] for p in own) == len(ids)
            assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]]) for p in own)


def test_neighbours_are_those_of_plain_bm25():
    from jambwork.llm import packing

    docs = [[1, 2, 2, 3], [2, 2, 9], [3, 3, 3, 1, 7, 7, 7, 7], [5], [1, 2, 3]]
    index = packing.Bm25(np.array(sum(docs, [])), np.append(0, np.cumsum([*map(len, docs)])))
    mean = np.mean([*map(len, docs)])

    def weight(t, d):
        df, tf = sum(t in x for x in docs), d.count(t)
        return math.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))

    for i, d in enumerate(docs):
        scores = [-sum(weight(t, e) for t in {*d}) for e in docs]
        want = sorted((j for j in range(len(docs)) if j != i), key=lambda j: (round(scores[j], 9), j))
        assert index.neighbours(i, np.arange(len(docs)) != i).tolist() == want


def test_fingerprints(spark, folder):
    docs = rows(folder, "documents")
    got = run(spark, "op2_fingerprints", folder)
    assert len(got) == len(docs)
    ids = Counter(d["doc_id"] for d in docs)
    ordered = sorted(docs, key=lambda d: d["doc_id"])
    by = {g["doc_id"]: g for g in got}
    marks = defaultdict(set)
    for d, e in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        if ids[d["doc_id"]] > 1 or ids[e["doc_id"]] > 1:
            continue
        g, t, u = by[d["doc_id"]], d["text"] or "", e["text"] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + u[:n]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        marks[t].add(g["fingerprint"])
        marks[edited].add(g["edited_fingerprint"])
        if t == edited:
            assert g["near_edited"] == 1
        elif len(t) > 400 and len(set(t)) > 8:
            assert g["near_edited"] > 0.4
        if t == u:
            assert g["near_next"] == 1
    assert all(len(x) == 1 for x in marks.values())
    assert len({next(iter(x)) for x in marks.values()}) == len(marks)


def test_jaccard(spark, folder):
    docs = [(d["doc_id"], d["text"]) for d in rows(folder, "documents")]
    root = linked(docs)
    want = Counter((d, len(shingles(t)), root[d]) for d, t in docs)
    assert Counter((g["doc_id"], g["n_shingles"], g["component_id"]) for g in run(spark, "op3_jaccard_join", folder)) == want


def test_fertility(spark, folder):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = run(spark, "op4_fertility", folder)
    assert Counter((g["doc_id"], *(g[x] for x in names)) for g in got) == Counter((d["doc_id"], *base_counts(d["text"])) for d in rows(folder, "documents"))
    for g in got:
        assert g["base_failed"] == (g["n_words"] < 20 or 100 * g["n_repeat_words"] > 30 * g["n_words"])
        assert not (g["base_failed"] and g["kept"])
    good = {r["doc_id"] for r in rows(folder, "labels") if r["quality"] == 1} if folder.endswith("sf0.001") else set()
    assert all(g["kept"] for g in got if g["doc_id"] in good and not g["base_failed"])


def test_bands_are_those_of_plain_medians(spark):
    from jambwork.llm import fertility

    r = np.random.default_rng(3)
    rows_, of = [], defaultdict(lambda: defaultdict(list))
    for i in range(300):
        lang, script = (("en", "latin"), ("latin", "latin"), ("xx", "greek"), (None, "greek"), ("yy", "thai"))[min(i % 7, 4)] if i < 295 else ("zz", "han")
        failed, n = bool(i % 11 == 0), int(r.integers(20, 900))
        x = [round(float(v), 4) for v in r.normal(4, 0.5, 4)]
        rows_.append((i, lang, script, "all", failed, n, *x))
        for key in (("lang", lang), ("script", script), ("every", "all")):
            if not failed and key[1] is not None:
                for name, v in zip(fertility.MEASURES, x, strict=True):
                    of[key][name].append((v, n))
    stats = spark.createDataFrame(rows_, "doc_id long, lang string, script string, every string, base_failed boolean, n_words long, " + ", ".join(f"{m} double" for m in fertility.MEASURES))
    got = {(b["scope"], b["key"]): b for b in fertility.bands(stats).collect()}
    assert {*got} == {*of}
    for key, by in of.items():
        for name, values in by.items():
            median = np.median([v for v, _ in values])
            spread = 1.4826 * np.median([abs(v - median) * n**0.5 for v, n in values])
            assert got[key]["texts"] == len(values) and got[key]["band"][name]["median"] == pytest.approx(median) and got[key]["band"][name]["spread"] == pytest.approx(spread, rel=0.02, abs=1e-6)


def test_junk_of_a_rare_language_meets_the_band_of_its_script(spark):
    from jambwork.llm import fertility
    from tests.llm.conftest import prose

    junk = " ".join("qzx" * 12 + f"{i * 7919}" for i in range(60))
    docs = [(i, "en", prose(i, 80)) for i in range(60)] + [(100, "en", junk), (101, "rare", junk), (102, None, junk), (103, "rare", prose(77, 80))]
    got = {r["doc_id"]: r["kept"] for r in fertility.judged(spark.createDataFrame(docs, "doc_id long, lang string, text string"), tokens.public("piece_bpe_32k.model"), tokens.public("byte_bpe_50k.json")).collect()}
    assert not got[100] and not got[101] and not got[102] and got[103]


def test_katz(spark, folder):
    docs = rows(folder, "documents")
    own = [(d["doc_id"], [*WORD.findall(lower(d["text"] or "")), None]) for d in docs]
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in own if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    bi = Counter(p for d, ws in own if not out(d) for p in zip(["<s>", *ws], ws, strict=False))

    def discounts(counts):
        t = Counter(counts.values())
        last = 6 * t[6] / t[1] if t[1] else 1
        d = {}
        for r in range(1, 6):
            x = ((r + 1) * t[r + 1] / (r * t[r]) - last) / (1 - last) if t[r] and last < 1 else 1
            d[r] = x if 0 < x < 1 else 1
        return lambda k: k * d.get(k, 1)

    one, two = discounts(c), discounts(bi)
    rest = 1 - sum(one(k) for k in c.values()) / n
    p1 = lambda w: (c[w] + 1) / (n + v + 1) if rest < 1e-12 else one(c[w]) / n if c[w] else rest
    after = defaultdict(list)
    for (h, w), k in bi.items():
        after[h].append((w, k))
    weight = {}
    for h, ws in after.items():
        total, kept, low = sum(k for _, k in ws), sum(two(k) for _, k in ws), sum(p1(w) for w, _ in ws)
        none = total - kept < 1e-9 * total
        weight[h] = (1 / (total + 1 if none else total), (1 / (total + 1) if none else (total - kept) / total) / max(1 - low, 1e-300))
    if folder.endswith("sf0.001"):
        words = [*c, "<unknown>"]
        for h in list(after)[:20]:  # the probabilities of a history sum to one
            s, b = weight[h]
            assert abs(sum(two(bi[h, w]) * s if bi[h, w] else b * p1(w) for w in words) - 1) < 1e-6

    def score(ws):
        out_ = 0.0
        for h, w in zip(["<s>", *ws], ws, strict=False):
            s, b = weight.get(h, (0, 1.0))
            out_ += math.log10(max(two(bi[h, w]) * s if bi[h, w] else b * p1(w), 1e-300))
        return out_

    want = sorted((d, len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), score(ws)) for d, ws in own)
    got = sorted((g["doc_id"], g["n_tokens"], g["n_known"], g["base_score"], g["score"]) for g in run(spark, "op5_katz", folder))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[3:] == pytest.approx(b[3:], rel=1e-9)
    assert all(g["held_out"] == out(g["doc_id"]) and g["train_tokens"] == n for g in run(spark, "op5_katz", folder))


def test_warc(spark, folder):
    pages = rows(folder, "pages")
    first = {}
    for p in pages:
        first[p["html"] or ""] = max(p["page_id"], first.get(p["html"] or "", -1))
    want = Counter()
    for p in pages:
        b = (p["html"] or "").encode()
        to = first[p["html"] or ""]
        want[p["page_id"], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to == p["page_id"] else "revisit", None if to == p["page_id"] else to] += 1
    got = run(spark, "op6_warc", folder)
    assert Counter((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got) == want
    order = [(g["url_key"], g["captured"], g["page_id"]) for g in sorted(got, key=lambda g: g["position"])]
    assert order == sorted(order) and len({g["position"] for g in got}) == len(got)


def test_loser_tree_merges_sorted_runs():
    import random

    from jambwork.llm.warc import LoserTree

    r = random.Random(5)
    for k in (0, 1, 2, 3, 7, 8, 33):
        runs = [sorted((r.randrange(20), i) for _ in range(r.randrange(12))) for i in range(k)]
        assert [*LoserTree(runs)] == sorted(sum(runs, []))


def test_long_pages_go_to_archives_of_their_own(spark, tmp_path):
    from jambwork.llm import warc

    pages = [(i, f"http://h{i % 3}/{i}", ("y" if i % 2 else f"{i} ") * (200_000 if i % 4 < 2 else 10)) for i in range(24)] + [(None, None, "x" * 100_000), (None, "http://n/", "z")]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(1), str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w"))
    assert Counter((r["page_id"], r["payload_bytes"]) for r in got.collect()) == Counter((p, len(h)) for p, _, h in pages)
    order = [(r["url_key"], r["captured"]) for r in warc.merged(got).orderBy("position").collect()]
    assert order == sorted(order)


def test_tool_calls(spark, odd):
    got = {(g["conv_id"], g["call_id"]): g for g in run(spark, "op7_tool_calls", odd)}
    assert got[1, "1:1"]["status"] == "linked" and got[1, "1:1"]["valid"] and '"hi \\"you\\" \\\\ ü"' in got[1, "1:1"]["json"]
    assert not got[1, "1:3"]["valid"] and got[1, "1:0"]["status"] == "no_result"
    assert not got[2, "2:0"]["valid"] and got[2, "2:0"]["n_results"] == 3
    assert got[3, "3:4"]["status"] == "orphan" and got[4, "4:0"]["n_calls"] == 2
    assert sum(g["status"] == "no_id" for g in run(spark, "op7_tool_calls", odd)) == 3


CALL, RESULT = "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>", "conv_id long, call_id string, position long, content string"


@pytest.mark.parametrize("at_once", [100_000, 3])
def test_calls_come_after_what_they_depend_on(spark, monkeypatch, at_once):
    from jambwork.llm import toolcalls

    monkeypatch.setattr(toolcalls, "AT_ONCE", at_once)
    on = {"a": ["b", "b"], "b": ["c"], "c": [], "d": ["e", "c"], "e": ["d"], "f": ["d"], "g": ["none", "c"], "h": ["a", "c"]}
    calls = [(k, c, i, "t", "{}", x) for k in (1, 2) for i, (c, x) in enumerate(on.items())] + [(3, "x", 0, "t", "{}", ["x"]), (3, "y", 1, "t", "{}", None)]
    calls += [(4, str(i), -i, "t", "{}", [str(i - 1)] if i else []) for i in range(40)]
    got = toolcalls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), {"t": {}}).collect()
    level = {(r["conv_id"], r["call_id"]): r["level"] for r in got}
    for k in (1, 2):
        assert [level[k, c] for c in "abcdefgh"] == [2, 1, 0, -1, -1, -1, 1, 3]
        order = [r["call_id"] for r in sorted((r for r in got if r["conv_id"] == k), key=lambda r: r["rank"])]
        assert order == ["c", "b", "g", "a", "h", "d", "e", "f"]
    assert level[3, "x"] == -1 and level[3, "y"] == 0 and all(level[4, str(i)] == i for i in range(40))


def test_arguments_that_are_not_json(spark):
    from jambwork.llm import toolcalls

    bad = ["[" * 100_000, "NaN", "[1e999]", "{", '{"a": 1}', '"\\ud800"', "1" * 5000]
    calls = [(1, str(i), i, "t", x, []) for i, x in enumerate(bad)] + [(1, "u", 9, "odd", "1", [])]
    got = {r["call_id"]: r for r in toolcalls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), {"t": {}, "odd": {"type": "tuple"}}).collect()}
    assert [got[str(i)]["valid"] for i in range(7)] == [False] * 4 + [True, True, False] and not got["u"]["valid"]
    assert "\ufffd" in got["5"]["json"]


def test_mixing(spark, folder):
    docs = rows(folder, "documents")
    size = lambda d: len(WORD.findall(d["text"] or ""))
    total = Counter()
    for d in docs:
        total[d["source"]] += size(d)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(total.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * total[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 3.0 * total[s] for s in over}
        left -= sum(3 * total[s] for s in over)
        open_ -= over
    got = run(spark, "op8_mix_sources", folder)
    assert Counter((g["doc_id"], g["size"]) for g in got) == Counter((d["doc_id"], size(d)) for d in docs)
    assert got == got and sorted(map(str, got)) == sorted(map(str, run(spark, "op8_mix_sources", folder)))
    taken = Counter()
    of = {d["doc_id"]: d["source"] for d in docs}
    for g in got:
        s = of[g["doc_id"]]
        taken[s] += g["taken"]
        assert 0 <= g["taken"] <= 3 * g["size"] and g["source_size"] == total[s] and g["target"] == pytest.approx(target[s])
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_each_stretch_of_the_schedule_has_the_mix_of_the_whole(spark):
    from jambwork.llm import mixing

    sizes = spark.createDataFrame([("a", 90_000), ("b", 7_000), ("c", 40_000), ("d", 300), (None, 21_000)], "source string, size long")
    plan = mixing.plan(mixing.targets(sizes))
    slots = {r["nr"]: r["slots"] for r in plan.collect()}
    total = sum(slots.values())
    rows = [r for r in mixing.schedule(plan).orderBy("slot").collect()]
    assert Counter(r["nr"] for r in rows) == slots and all(sorted(r["rank"] for r in rows if r["nr"] == k) == [*range(n)] for k, n in slots.items())
    seen = Counter()
    for k, r in enumerate((r for r in rows if r["slot"] < total), 1):
        seen[r["nr"]] += 1
        assert all(abs(seen[s] - k * n / total) <= 4 for s, n in slots.items())
    assert len([r for r in rows if r["slot"] >= total]) <= 4 * len(slots)


def test_toxicity(spark, folder):
    got = run(spark, "op9_toxicity", folder)
    assert len(got) == len(rows(folder, "documents"))
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) and g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) for g in got)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["toxic"] for r in rows(folder, "labels")}
    got = [(label[g["doc_id"]], g["score"], g["predicted"]) for g in run(spark, "op9_toxicity", folder) if g["held_out"] and g["doc_id"] in label]
    bad, good = [s for y, s, _ in got if y], [s for y, s, _ in got if not y]
    assert sum(p == y for y, _, p in got) >= 0.9 * len(got)
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) >= 0.7 * len(bad) * len(good)


def test_suffix_dedup(spark, folder):
    docs = rows(folder, "documents")
    texts = [(d["text"] or "").encode() for d in docs]
    want = Counter((d["doc_id"], len(t), n, k, hashlib.sha256(kept).hexdigest()) for d, t, (kept, n, k) in zip(docs, texts, cut(texts), strict=True))
    assert Counter((g["doc_id"], g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for g in run(spark, "op10_suffix_dedup", folder)) == want


def test_anchors_above_the_bound_are_matched_alike(spark, odd):
    from jambwork.llm import suffixes

    docs = rows(odd, "documents")
    texts = [(d["text"] or "").encode() for d in docs]
    want = {t: (n, k, hashlib.sha256(kept).hexdigest()) for t, (kept, n, k) in zip(texts, cut(texts), strict=True)}
    for hot in (0, 2):
        keys, out = suffixes.repeats(spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text"), hot=hot)
        got = keys.join(out, ["text_id", "check"]).select("text", "n_removed", "n_spans", "kept_sha256").collect()
        assert {r["text"].encode(): tuple(r)[1:] for r in got} == want and len(got) == len(texts)


def test_deep_arguments_are_errors(spark):
    """Arguments nested to just what a parser bears can't end the job: from MOST_DEEP on they are no JSON."""
    from jambwork.llm import toolcalls

    nest = lambda n: '{"text":' + "[" * n + "]" * n + "}"
    depths = [1, toolcalls.MOST_DEEP - 1, toolcalls.MOST_DEEP, 900, 9_990, 100_000]
    calls = [(1, f"c{n}", 0, "t", nest(n), []) for n in depths]
    got = {r["call_id"]: r for r in toolcalls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), {"t": {}}).collect()}
    assert [got[f"c{n}"]["errors"] == [] for n in depths] == [True, True, False, False, False, False]
