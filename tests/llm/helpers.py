"""Reading and writing of small Parquet tables, and the plain versions of what operators count."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq

KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def write(root, name: str, rows: list[tuple], schema: str) -> None:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
    pq.write_table(pa.table({n: pa.array(c, KINDS[k]) for (n, k), c in zip(fields, cols, strict=True)}), f"{root}/{name}.parquet")


def rows(folder: str, name: str) -> list[dict]:
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text: str | None, n: int = 5) -> set:
    w = WORD.findall(lower(text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def linked(docs: list[tuple[int, str | None]], percent: int = 80) -> dict[int, int]:
    """component_id of each doc_id, by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {d: find(d) for d in root}


def cut(texts: list[bytes], length: int = 200) -> list[tuple[bytes, int, int]]:
    """(kept bytes, removed bytes, spans) of each text, from counts of all windows."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(gone), spans))
    return out


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    repeat = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat)
