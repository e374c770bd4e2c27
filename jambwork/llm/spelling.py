"""Spelling variants: words that differ by one code point, and the form that each stands for.

The words of a table with their counts are cut into ranges; each range becomes
compact tries (shards) of bounded size: for every node two words of 64 bits say which
letters follow, and where the children begin. Shards are broadcast in rounds of bounded
size. Tasks intersect the distance-one Levenshtein automata of their words with every
shard depth-first: the exact path of a word is followed from the root, and at each of
its nodes all edits leave it, whose paths are followed to their ends before the next
node. Automata of a block of words take their steps together, in arrays. An edit within
a run of equal letters counts once, at the run's end, so each neighbour is accepted once.

Counts of neighbours and best forms are reduced by Spark; forms are followed to their
last by doubling. A form has at least twice its word's count, so none leads back.

Words have letters a-z and U+00C0 to U+00FF. Null words are left out, the count of a
repeated word is the sum of its rows'; a word of any length is a word, and the automata
go as deep as it. Other columns are not read.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.llm import kernels as K
from jambwork.llm.common import parts, scratch, stored, table

#: Words of a shard; bytes of shards in one broadcast; words whose automata step together.
SHARD_WORDS, ROUND_BYTES, AT_ONCE = 100_000, 64 << 20, 8192
#: Nodes are this deep at most. Words that share as much have one node there, and their rests are looked up in a table.
DEPTH = 250
#: Rows of counts that a task holds before it passes them on; bytes of text at once.
HELD, BYTES_AT_ONCE = 400_000, 1 << 22
U64 = np.uint64
END = 255

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _gaps(buf: np.ndarray) -> np.ndarray:
    """Bytes outside of runs of letters: A-Z, a-z, and U+00C0 to U+00FF, which are 0xC3 and a byte in UTF-8."""
    inside = _LETTER[buf] | (buf == 0xC3)
    inside[1:] |= buf[:-1] == 0xC3
    return ~inside


# ---- words and counts -------------------------------------------------------

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crc32(words: K.Words, before: np.ndarray) -> np.ndarray:
    """The crc32 of each word's bytes that follow others; before: the crc32 of these, by text."""
    size = words.end - words.start
    order = np.argsort(-np.minimum(size, 65), kind="stable")
    start, sorted_size = words.start[order], size[order]
    state = before[words.doc[order]] ^ np.uint32(0xFFFFFFFF)
    for k in range(min(64, int(sorted_size.max(initial=0)))):
        n = int(np.searchsorted(-np.minimum(sorted_size, 65), -k, "left"))
        state[:n] = _CRC[(state[:n] ^ words.buf[start[:n] + k]) & 255] ^ state[:n] >> np.uint32(8)
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = zlib.crc32(words.buf[words.start[i] : words.end[i]], int(before[words.doc[i]]))
    return out


def _spoilt(words: K.Words, ids: list, modulus: int) -> tuple[np.ndarray, list[str]]:
    """Where a word loses a letter (by the hash of the text's id and it), and what is left of these."""
    before = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids], np.uint32)
    h = crc32(words, before)
    at = np.flatnonzero(h % modulus == 0)
    left = []
    for i in at.tolist():
        word = words.buf[words.start[i] : words.end[i]].tobytes().decode()
        k = int(h[i]) % len(word)
        left.append(word[:k] + word[k + 1 :])
    return at, left


def word_counts(docs: DataFrame, shortest: int = 1, spoil: int | None = None) -> DataFrame:
    """word and n: how often texts have each run of letters, A-Z as a-z, of at least `shortest` code points.

    spoil: a run whose crc32 with its text's id this divides loses one code point first. Tasks add up what they can hold.
    """

    def counted(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), K.strings(batch.column("text"))
            for at, buf, off in K.pieces(texts, BYTES_AT_ONCE):
                words = K.Words(buf, off, gaps=_gaps)
                wide = np.append(0, np.cumsum(words.buf == 0xC3))
                keep = words.end - words.start - (wide[words.end] - wide[words.start]) >= shortest
                left: list[str] = []
                if spoil:
                    lost, left = _spoilt(words, ids[at : at + len(off) - 1], spoil)
                    keep[lost] = False
                for found in (words.strings().filter(pa.array(keep)), pa.array([x for x in left if len(x) >= shortest], pa.large_string())):
                    n = found.value_counts()
                    held.append(pa.table({"word": n.field("values"), "n": n.field("counts")}))
                    size += len(n)
                if size > 4 * HELD:
                    held = [counted(held)]
                    if (size := len(held[0])) > HELD:
                        yield from _batches(held.pop())
                        size = 0
        if held:
            yield from _batches(counted(held))

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _batches(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(rows.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches(100_000))


# ---- tries ------------------------------------------------------------------


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words as numbers in code-point order, and the offsets of each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    plain, wide = (points >= 97) & (points <= 122), (points >= 0xC0) & (points <= 0xFF)
    if not (plain | wide).all():
        raise ValueError("words have letters a-z and U+00C0 to U+00FF")
    return np.where(plain, points - 97, points - 0xC0 + 26).astype(np.uint8), np.append(0, np.cumsum([len(x) for x in words])).astype(np.int64)


def build(words: list[str], n: np.ndarray) -> bytes:
    """A shard: the trie of distinct words in code-point order, with their counts."""
    flat, off = _codes(words)
    size = np.diff(off)
    deep = int(min(size.max(), DEPTH))
    cols = np.arange(deep)
    letters = np.full((len(words), deep), END, np.uint8)
    inside = cols < size[:, None]
    letters[inside] = flat[(off[:-1, None] + cols)[inside]]
    same = np.zeros(len(words), np.int64)  # letters in common with the word before
    same[1:] = np.cumprod((letters[1:] == letters[:-1]) & inside[1:], 1).sum(1)
    same[0] = -1
    node = np.zeros(len(words), np.int64)
    total, chars, parents, of_word, deepest = 1, [np.zeros(1, np.uint8)], [np.zeros(1, np.int64)], [np.array([-1])], node
    for d in range(1, deep + 1):
        rows = np.flatnonzero(size >= d)
        new = same[rows] < d
        here = total + np.cumsum(new) - 1
        chars.append(letters[rows[new], d - 1])
        parents.append(node[rows[new]])
        ends = np.full(int(new.sum()), -1)
        stop = size[rows] == d
        ends[here[stop] - total] = rows[stop]
        of_word.append(ends)
        node = node.copy()
        node[rows] = here
        total += int(new.sum())
    deepest = node
    char, parent, word = np.concatenate(chars), np.concatenate(parents), np.concatenate(of_word)
    masks = np.zeros((2, total), U64)
    first = np.zeros(total, np.int64)
    np.bitwise_or.at(masks, (char[1:] >> 6, parent[1:]), U64(1) << (char[1:] & 63).astype(U64))
    first[parent[:0:-1]] = np.arange(total - 1, 0, -1)
    long = np.flatnonzero(size > DEPTH)
    out = io.BytesIO()
    np.savez(out, masks=masks, first=first.astype(np.uint32), char=char, word=word.astype(np.int32), n=n, long=long, long_node=deepest[long], text=np.frombuffer("\n".join(words).encode(), np.uint8))
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


class Shard:
    """A trie, and the automata that run over it."""

    def __init__(self, data: bytes):
        x = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data)))
        self.low, self.high = x["masks"]
        self.first, self.char, self.word, self.n = x["first"].astype(np.int64), x["char"], x["word"], x["n"]
        self.below = np.bitwise_count(self.low).astype(np.int64)
        self.kids = self.below + np.bitwise_count(self.high)
        self.words = x["text"].tobytes().decode().split("\n")
        #: Of nodes at the greatest depth: what follows there, and the word's number.
        self.rests: dict[int, dict[str, int]] = {}
        for k, node in zip(x["long"].tolist(), x["long_node"].tolist(), strict=True):
            self.rests.setdefault(node, {})[self.words[k][DEPTH:]] = k

    def step(self, node: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is one, child) of nodes by a letter."""
        high = c >= 64
        mask = np.where(high, self.high[node], self.low[node])
        bit = U64(1) << (c & 63).astype(U64)
        return mask & bit != 0, self.first[node] + np.bitwise_count(mask & (bit - U64(1))) + np.where(high, self.below[node], 0)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place in words, number of a word of the trie) of all pairs that differ by one code point."""
        flat, off = _codes(words)
        size = np.diff(off)
        flat = np.append(flat, np.uint8(END))
        letter = lambda w, at: np.where(at < size[w], flat[np.minimum(off[w] + at, len(flat) - 1)], END)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def follow(w, at, node):
            """The paths of automata after their edit: nothing but the rest of the word is accepted."""
            while len(w):
                if self.rests and d < DEPTH:  # _deep_exact has what is edited below
                    self._deep(words, w, at, node, found)
                over = at == size[w]
                hit = over & (self.word[node] >= 0)
                found.append((w[hit], self.word[node[hit]]))
                w, at, node = w[~over], at[~over], node[~over]
                there, child = self.step(node, letter(w, at))
                w, at, node = w[there], at[there] + 1, child[there]

        w, node, d = np.arange(len(words)), np.zeros(len(words), np.int64), 0
        while len(w):
            if self.rests:
                self._deep_exact(words, w, d, node, found)
            c, more = letter(w, np.full(len(w), d)), size[w] > d
            drop = more & (letter(w, np.full(len(w), d + 1)) != c)
            follow(w[drop], np.full(int(drop.sum()), d + 1), node[drop])
            kids = self.kids[node]
            which = np.repeat(np.arange(len(w)), kids)
            child = np.repeat(self.first[node] - np.append(0, np.cumsum(kids)[:-1]), kids) + np.arange(len(which))
            other = self.char[child] != c[which]
            which, child = which[other], child[other]
            follow(w[which], np.full(len(which), d), child)
            can = more[which]
            follow(w[which[can]], np.full(int(can.sum()), d + 1), child[can])
            w, node, c = w[more], node[more], c[more]
            there, child = self.step(node, c)
            w, node, d = w[there], child[there], d + 1
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2

    def _deep(self, words, w, at, node, found) -> None:
        """Rests below the deepest nodes that are just the rest of the word."""
        for i in np.flatnonzero(np.isin(node, [*self.rests])).tolist():
            k = self.rests[int(node[i])].get(words[w[i]][at[i] :])
            if k is not None:
                found.append((w[i : i + 1], np.array([k])))

    def _deep_exact(self, words, w, d, node, found) -> None:
        """Rests below the deepest nodes that one edit makes of the rest of the word."""
        for i in np.flatnonzero(np.isin(node, [*self.rests])).tolist():
            rests, own = self.rests[int(node[i])], words[w[i]][d:]
            ks = [k for x, k in rests.items() if abs(len(x) - len(own)) < 2 and x != own and _one_edit(x, own)]
            found.append((np.full(len(ks), w[i]), np.array(ks, np.int64)))


def _one_edit(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def shards(words: DataFrame) -> DataFrame:
    """size (bytes) and shard of each trie. words: distinct word, n."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in batches:
            held.append(batch)
            total += batch.num_rows
            while total >= SHARD_WORDS:
                rows = pa.Table.from_batches(held)
                yield made(rows.slice(0, SHARD_WORDS))
                held, total = rows.slice(SHARD_WORDS).to_batches(), total - SHARD_WORDS
        if total:
            yield made(pa.Table.from_batches(held))

    def made(rows: pa.Table) -> pa.RecordBatch:
        data = build(rows.column("word").to_pylist(), rows.column("n").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array([len(data)]), pa.array([data], pa.binary())], names=["size", "shard"])

    ranges = max(1, -(-words.count() // SHARD_WORDS))
    return words.repartitionByRange(ranges, "word").sortWithinPartitions("word").mapInArrow(run, "size long, shard binary")


def neighbours(words: DataFrame) -> DataFrame:
    """word, near and near_n (the count of near) of all pairs of words that differ by one code point, both ways round.

    words: distinct word, n; its rows are computed more than once, so they should be stored.
    """
    spark = words.sparkSession
    tries = stored(shards(words).withColumn("id", F.monotonically_increasing_id()))
    asked = stored(words.select("word").repartitionByRange(parts(spark), "word").sortWithinPartitions("word"))
    rounds: list[list[int]] = []
    room = 0
    for x in tries.select("id", "size").orderBy("id").toLocalIterator():
        if x["size"] > room:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append(x["id"])
        room -= x["size"]
    out = []
    for ids in rounds:
        held = spark.sparkContext.broadcast([bytes(x["shard"]) for x in tries.where(F.col("id").between(ids[0], ids[-1])).select("shard").collect()])
        out.append(stored(asked.mapInArrow(_round(held), "word string, near string, near_n long")))
        held.destroy()
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "word string, near string, near_n long")


def _round(held):
    def run(batches):
        tries = None
        for batch in batches:
            tries = tries or [Shard(x) for x in held.value]
            for at in range(0, batch.num_rows, AT_ONCE):
                words = batch.column("word").slice(at, AT_ONCE)
                own = words.to_pylist()
                for trie in tries:
                    w, k = trie.near(own)
                    near = pa.array([trie.words[i] for i in k.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(w)), near, pa.array(trie.n[k])], names=["word", "near", "near_n"])

    return run


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word.

    form is the near word of largest n (of equals the smallest), if that is at least `times` the word's; root is
    where the forms lead from the word. words: word, n.
    """
    with scratch(words.sparkSession):
        words = stored(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
        best = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
        own = F.col("n") * times <= -F.col("best.n")
        rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(own, F.col("best.form")).alias("form"), F.when(own, -F.col("best.n")).alias("form_n"))
        rows = stored(rows)
        hop = rows.where("form is not null").select("word", F.col("form").alias("root"))
        while True:
            far = hop.select(F.col("word").alias("root"), F.col("root").alias("far"))
            hop = stored(hop.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
            if hop.where("moved").isEmpty():
                break
            hop = hop.drop("moved")
        return stored(rows.join(hop.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word")), keep=True)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of at least five code points and three occurrences, some of which lose a letter first."""
    counts = word_counts(table(spark, sf_dir, "documents"), shortest=5, spoil=97).where("n >= 3")
    return variants(counts).select("word", "form", "root", "n", "n_near", "form_n")
