"""Groups that are done stay out of later rounds of exclusive matching."""

from __future__ import annotations

from jambwork.operators import matching


def test_only_refused_groups_go_on(spark, monkeypatch):
    """One group of a chain of refusals among many where all get what they want: later rounds hold its pairs only."""
    calm = [(g, f"a{i}", f"b{i}", i, 0) for g in range(2, 40) for i in range(5)]
    chain = [(1, f"a{a}", f"b{b}", b, a) for b in range(6) for a in range(6)]
    kept, plain = [], matching.stored

    def stored(rows):
        out = plain(rows)
        if "choice" in out.columns:
            kept.append({r["block"] for r in out.select("block").distinct().collect()})
        return out

    monkeypatch.setattr(matching, "stored", stored)
    got = matching.exclusive(spark.createDataFrame(calm + chain, "block int, a string, b string, turn int, choice int"), ["block"])
    want = {(g, a, b) for g, a, b, _, _ in calm} | {(1, f"a{i}", f"b{i}") for i in range(6)}
    assert {tuple(r) for r in got.select("block", "a", "b").collect()} == want
    assert len(kept) > 2 and all(x == {1} for x in kept[1:])
