"""Exact Jaccard join of word n-gram sets, with set relations used to skip work.

Two sets link when 100 * |x & y| >= percent * |x | y|. Sets are compared once
each, whatever the number of texts that have them. The tokens of a set are
ordered alike everywhere, rare ones first, and only a prefix of each set is
indexed: linked sets share a token of both prefixes.

The order is of three parts. Tokens with small hashes, `SEEN` of all, come first,
by the number of sets that have them, which one shuffle of them tells exactly.
Those that only one set has can't link it, and are in no list; a set with enough
of them is in no list at all. Other tokens follow by hash. Last are the tokens of
very full buckets, by the bucket's count: their lists are spread over tasks.

* Skipping in lists: an entry of an index list holds its set's size and the
  token's position. Entries are blocked by both, and a pair of blocks whose
  sizes or remaining tokens can't reach the overlap is skipped whole.
* Skipping by answers: the entries of a list are first compared with one leader
  only. What a set has in common with its leader is kept as its answer. A set
  that links with the leader takes over its class, and what is left to find for
  it are sets of other classes. Of two sets with one leader, the answers bound
  what they have in common: no more than both share with the leader, and what
  each has beyond it. Pairs that can't reach the overlap are skipped by their
  leader's answers, and others by the parities of their tokens in 512 buckets,
  which differ in no more places than the sets. What is left is compared.

When rounds no longer pay, all pairs of different classes that the index still
has and that no bound excludes are compared exactly, so no link between classes
is missed. Where these could be many, pairs are dealt out by their hashes, into
shares that grow by four: what a small share links is one class, and is in no
pair of the larger ones. So a group of alike sets, of which each links with some
others, takes pairs as many as its sets and not as their square.

Buckets are as many at any size of the corpus, and what tasks get of them is
their counts, 8 MB. A list outside full buckets has at most `FULL` entries, or
`TIMES` the mean of all buckets.

Null and empty texts, and those without a word, have an empty set and link with
nothing. Texts of fewer than n words are one shingle. Rows that share a doc_id
stay rows, and count as linked. Rows whose doc_id is null link by their sets
only; a class without any doc_id has none as its component_id.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jambwork.llm import kernels as K
from jambwork.llm.common import arrow_map, components, parts, scratch, stored, table, with_groups, with_row_keys

WORDS, PERCENT = 5, 80
#: Bits of a token's hash that name its bucket, and buckets that are one row.
BUCKET_BITS, BLOCK = 23, 1 << 16
#: Tokens in a full bucket: so many, and so many times the mean. Tasks over which the list of a token there is spread.
FULL, TIMES, SPREAD = 1024, 16, 64
#: The share of tokens that are counted one by one.
SEEN = 0.375
#: Leader rounds at most, leaders that a set is compared with in each, pairs of different classes for each entry of the lists above which a round pays, and the share of pairs that it must have taken for another.
ROUNDS, TRIES, PAIRS, PAID = 8, 4, 2, 0.2
#: Lists that an entry knows of those before it in its set.
BEFORE = 6
#: Words of 64 bits with the parities of a set's tokens by bucket.
SIGNS = 8
#: Growth of set sizes from one bin to the next.
BIN = 1.12
U64 = np.uint64


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """The least intersection with which sets of n and m tokens link."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent)).cast("long")


def _profile(docs: DataFrame, levels, words: int) -> DataFrame:
    """The columns of docs but text, which are longs, with set size n, number v of counted tokens, a hash of the set, and its tokens' parities s0, s1, .."""
    own = [x for x in docs.columns if x != "text"]

    def run(batch):
        for i, buf, off in K.pieces(K.strings(batch.column("text"))):
            n = len(off) - 1
            g, at = K.sets(*K.shingles(K.Words(buf, off), words), n)
            seen = np.bincount(np.repeat(np.arange(n), np.diff(at))[_kinds(g, levels.value)[0] == 0], minlength=n)
            yield *(batch.column(x).slice(i, n) for x in own), np.diff(at), seen, _nodes(g, at, 1), *_parities(g, at)

    return arrow_map(docs.select(*own, "text"), run, "".join(f"{x} long, " for x in own) + "n long, v long, node long" + "".join(f", s{k} long" for k in range(SIGNS)))


def _kinds(g: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of the order that each token belongs to (0: counted, 1: not counted, 2: of a full bucket), and its bucket's level (0 if not full)."""
    level = levels[(g & U64((1 << BUCKET_BITS) - 1)).astype(np.int64)]
    return np.where(level > 0, 2, (g >= U64(int(SEEN * 2**64))).astype(np.int64)), level


def _parities(g: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    n, bits = len(at) - 1, 64 * SIGNS
    count = np.zeros((n, bits), np.uint8)
    bucket = (g >> U64(20)) % U64(bits)
    where, times = np.unique(np.repeat(np.arange(n), np.diff(at)) * bits + bucket.astype(np.int64), return_counts=True)
    count.ravel()[where] = times & 1
    return [*np.packbits(count, axis=1).view(np.int64).T]


def _prefix_size(size: np.ndarray, percent: int) -> np.ndarray:
    return size - -(-percent * size // 100) + 1


def _levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each bucket of tokens 0, or if it is full a number that grows with its count (quarters of the logarithm to base 2).

    A task counts the copies of a set that it has seen once. Counts are added up bucket by bucket, twice, so that nobody adds what all tasks have.
    """
    size = 1 << BUCKET_BITS

    def count(batches):
        seen: set[int] = set()
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for _, buf, off in K.pieces(K.strings(batch.column("text"))):
                g, at = K.sets(*K.shingles(K.Words(buf, off), words), len(off) - 1)
                fresh = np.array([x not in seen and not seen.add(x) for x in _nodes(g, at, 1).tolist()], bool)
                t, c = np.unique((g[np.repeat(fresh, np.diff(at))] & U64(size - 1)).astype(np.uint32), return_counts=True)
                total[t] += c.astype(np.uint32)
        yield from sums({k: total[k * BLOCK : (k + 1) * BLOCK] for k in range(size // BLOCK)})

    def sums(totals: dict[int, np.ndarray]):
        press, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() % SPREAD
        some = [(k, part, press.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())) for k, x in totals.items() if x.any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "part", "counts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                totals[k] = np.minimum(totals[k] + counts(data).astype(np.uint64), 0xFFFFFFFF).astype(np.uint32) if k in totals else counts(data)
        yield from sums(totals)

    def counts(data: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()

    schema, n = "block int, part int, counts binary", parts(docs.sparkSession)
    rows = docs.select("text").mapInArrow(count, schema).repartition(n, "block", "part").mapInArrow(add, schema)
    total = np.zeros(size, np.uint32)
    for x in rows.repartition(n, "block").mapInArrow(add, schema).toLocalIterator():  # a row for each block
        total[x["block"] * BLOCK : (x["block"] + 1) * BLOCK] = counts(bytes(x["counts"]))
    full = max(FULL, TIMES * total.mean())
    return np.where(total > full, np.rint(4 * np.log2(total + 1.0)), 0).astype(np.uint8)


def _entries(docs: DataFrame, levels, words: int, percent: int) -> DataFrame:
    """key (57 bits of a token, 7 of a salt), node and pos of the counted tokens of each set (salt 0, pos -1), and of the others in its prefix; in full buckets salts begin with 1.

    A task passes over the copies of a set that it has seen.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, buf, off in K.pieces(K.strings(batch.column("text"))):
                n = len(off) - 1
                g, at = K.sets(*K.shingles(K.Words(buf, off), words), n)
                size = np.diff(at)
                node = _nodes(g, at, 1)
                fresh = np.array([x != 0 and x not in seen and not seen.add(x) for x in node.tolist()], bool)
                kind, level = _kinds(g, levels.value)
                d = np.repeat(np.arange(n), size)
                order = np.lexsort((level, kind, d)) if len(g) else np.zeros(0, np.int64)
                g, kind, d = g[order], kind[order], d[order]
                pos = np.arange(len(g)) - np.repeat(at[:-1], size)
                keep = fresh[d] & ((kind == 0) | (pos < _prefix_size(size, percent)[d]))
                g, kind, d, pos = g[keep], kind[keep], d[keep], pos[keep]
                key = (g & ~U64(127)) | np.where(kind == 2, 1 + node[d] % SPREAD, 0).astype(U64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[d]), pa.array(np.where(kind == 0, -1, pos).astype(np.int32))], names=["key_", "node_", "pos_"])

    # the new names let Spark see that both uses of the rows are the same exchange
    return docs.select("text").mapInArrow(run, "key_ long, node_ long, pos_ int").select(F.col("key_").alias("key"), F.col("node_").alias("node"), F.col("pos_").alias("pos"))


def _postings(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """token, node, n and pos of the prefixes, without tokens that only one set has."""
    lists = with_groups(entries, ["key"], F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"))
    lists = lists.where("low < high or key & 127 > 0").groupBy("key", "node").agg(F.max("pos").alias("pos"), F.max("c").alias("c"))
    lists = lists.select(F.shiftrightunsigned("key", 7).alias("token"), "node", "pos", "c")
    # those that are left out, which are v less the ones that are here, come first
    w = Window.partitionBy("node")
    placed = lists.withColumn("here", F.count(F.when(F.col("pos") < 0, 1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("pos") >= 0, "c", "token")))
    rows = placed.join(sets.select("node", "n", "v"), "node").withColumn("pos", F.expr("cast(if(pos < 0, v - here + rank - 1, pos) as int)"))
    return rows.where(F.expr(f"pos < n - ({percent} * n + 99) div 100 + 1")).select("token", "node", F.col("n").cast("int").alias("n"), "pos")


def _once(entries: DataFrame) -> DataFrame:
    """The entries of each set of lists with the same nodes: of the token that comes first, as in all of them it does so for each node."""
    mark = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    lists = entries.groupBy("token").agg(F.count("*").alias("c"), *mark, F.min(F.struct("node", "pos")).alias("at"))
    first = lists.where("c > 1").groupBy("c", "x0", "x1", "at.node").agg(F.min_by("token", F.struct("at.pos", "token")).alias("token"))
    return entries.join(first.select("token"), "token", "left_semi")


def _nodes(g: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each set; 0 of the empty set."""
    size = np.diff(at)
    total = np.add.reduceat(np.append(K.mix(g ^ U64(seed)), U64(0)), np.minimum(at[:-1], len(g)))
    return np.where(size > 0, K.mix(total + size.astype(U64)), U64(0)).view(np.int64)


def _pressed(docs: DataFrame) -> DataFrame:
    """doc_id, and the text compressed: what is moved and kept of texts."""

    def run(batch):
        press = zstandard.ZstdCompressor(level=1)
        yield batch.column("doc_id"), pa.array([press.compress(x.as_buffer()) for x in batch.column("text").cast(pa.binary())], pa.binary())

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, text binary")


def _nameless(docs: DataFrame, words: int) -> DataFrame:
    """node and compressed text of the rows without a doc_id, each set once in a task."""

    def run(batches):
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            texts = K.strings(batch.column("text"))
            for i, buf, off in K.pieces(texts):
                node = _nodes(*K.sets(*K.shingles(K.Words(buf, off), words), len(off) - 1), 1)
                at = [k for k, x in enumerate(node.tolist()) if x and x not in seen and not seen.add(x)]
                text = [press.compress(buf[off[k] : off[k + 1]].tobytes()) for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(text, pa.binary())], names=["node", "text"])

    return docs.where("doc_id is null").select("text").mapInArrow(run, "node long, text binary")


def _sides(sets: DataFrame, rounds: int, *names: str) -> list[DataFrame]:
    """For each name x the sets as node `x`, with what `_open` needs of them, their columns ending in _x."""
    own = ["n", *(f"s{k}" for k in range(SIGNS)), *(f"{x}{t}" for t in range(rounds) for x in ("to", "o"))]
    return [sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in own)) for x in names]


def _open(percent: int, rounds: int) -> Column:
    """Whether neither the answers of a common leader nor the parities exclude that the sets a and b link.

    Of each round they have the leader `to0`, .. and the overlap with it `o0`, ..
    """
    n, m = F.col("n_a"), F.col("n_b")
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(SIGNS)))
    open_ = (n + m - differ) * (100 + percent) >= 2 * percent * (n + m)
    for t in range(rounds):
        o, p, to, at = (F.col(f"{x}{t}_{y}") for x, y in (("o", "a"), ("o", "b"), ("to", "a"), ("to", "b")))
        most = F.least(o, p) + F.least(n - o, m - p)
        done = (to == F.col("b")) | (at == F.col("a")) | ((to == at) & (most * (100 + percent) < percent * (n + m)))
        open_ &= ~F.coalesce(done, F.lit(False))
    return open_


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int, rounds: int) -> DataFrame:
    """The pairs (a, b) of nodes that are open."""
    one, two = _sides(sets, rounds, "a", "b")
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(_open(percent, rounds)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes with the overlap of their sets, and whether they link."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts.join(need, "node", "left_semi")
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")

    def run(batch):
        press = zstandard.ZstdDecompressor()
        a, b = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
        left, right = batch.column("left"), batch.column("right")
        at = 0
        while at < len(a):
            x, y, size, to = [], [], 0, at
            while to < len(a) and (to == at or size < K.PIECE_BYTES):
                x.append(press.decompress(left[to].as_py()))
                y.append(press.decompress(right[to].as_py()))
                size += len(x[-1]) + len(y[-1])
                to += 1
            n = to - at
            (g, u), (h, v) = (K.sets(*K.shingles(K.Words(np.frombuffer(b"".join(t), np.uint8), np.append(0, np.cumsum([len(z) for z in t]))), words), n) for t in (x, y))
            d = np.concatenate([np.repeat(np.arange(n), np.diff(u)), np.repeat(np.arange(n), np.diff(v))])
            t = np.concatenate([g, h])
            order = K.by_text(t, d)
            t, d = t[order], d[order]
            both = np.bincount(d[1:][(t[1:] == t[:-1]) & (d[1:] == d[:-1])], minlength=n)
            yield a[at:to], b[at:to], both, 100 * both >= percent * (np.diff(u) + np.diff(v) - both)
            at = to

    return arrow_map(both, run, "a long, b long, overlap long, linked boolean")


def _classes(links: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries of lists that hold more than one class, with the class of each."""
    root = components(links).select("node", F.col("root").alias("class"))
    entries = stored(entries.drop("class").join(root, "node", "left").withColumn("class", F.coalesce("class", "node")))
    mixed = entries.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    return stored(entries.join(mixed.select("token"), "token", "left_semi"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) of each row of docs (doc_id, text)."""
    with scratch(docs.sparkSession):
        return stored(_joined(docs, words, percent).select("doc_id", "n_shingles", "component_id"), keep=True)


def _joined(docs: DataFrame, words: int, percent: int, *keys: str) -> DataFrame:
    """What join returns, the root that linked sets share (null without a set), and the keys (longs), of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keys)
    levels = docs.sparkSession.sparkContext.broadcast(_levels(docs, words))
    own = stored(_profile(docs, levels, words))
    signs = [f"s{k}" for k in range(SIGNS)]
    sets = stored(own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.max(x).alias(x) for x in ("n", "v", *signs))))
    own = own.drop("v", *signs)
    postings = stored(_postings(_entries(docs, levels, words, percent), sets, percent))
    levels.unpersist()
    postings = stored(_once(postings))

    first = own.where("n > 0").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    links = stored(own.where("n > 0").join(first.where("a < b").select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b"))
    near = sets.join(postings.select("node").distinct(), "node").select("doc_id", "node")
    nameless = _nameless(docs, words).join(sets.where("doc_id is null"), "node", "left_semi")
    texts = stored(_own_text(_pressed(docs).join(near, "doc_id").select("node", "text").unionByName(nameless), words))
    entries = _classes(links, postings)
    known, rounds, before, many = sets.drop("doc_id", "v"), 0, math.inf, 1.0
    for turn in range(ROUNDS):
        node = F.struct(F.xxhash64("node", F.lit(turn)).alias("k"), F.col("node"), F.col("n"), F.col("pos"))
        by_class = stored(entries.groupBy("token", "class").agg(F.count("*").alias("c"), F.min(node).alias("to")))
        size = by_class.groupBy("token").agg(F.sum("c").alias("all"), F.sum(F.expr("double(c) * c")).alias("alike")).agg(F.sum("all").alias("entries"), F.sum(F.expr("(double(all) * all - alike) / 2")).alias("pairs")).first()
        many = (size.pairs or 0) / max(1, PAIRS * (size.entries or 0))
        if (size.pairs or 0) <= PAIRS * (size.entries or 0) or size.pairs > (1 - PAID) * before:
            break
        before = size.pairs
        # a node of the largest class leads
        leader = by_class.groupBy("token").agg(F.max_by(F.struct("class", "to"), F.struct("c", F.xxhash64("class", F.lit(turn)))).alias("l"))
        leader = leader.select("token", F.col("l.to.node").alias("to"), F.col("l.class").alias("to_class"), F.col("l.to.n").alias("m"), F.col("l.to.pos").alias("at"))
        met = entries.join(leader, "token").where(F.col("class") != F.col("to_class")).where(_possible(percent))
        turns = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "to"))
        best = met.groupBy("node", "to").count().withColumn("try", turns).where(F.col("try") <= TRIES)
        pairs = stored(_bounded(best.select(F.col("node").alias("a"), F.col("to").alias("b")), known, percent, rounds))
        found = stored(_verified(pairs, texts, words, percent))
        nearest = found.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("overlap", "b")).alias("best"))
        answers = nearest.select("node", F.col("best.b").alias(f"to{rounds}"), F.col("best.overlap").alias(f"o{rounds}"))
        known, rounds = stored(known.join(answers, "node", "left")), rounds + 1
        links = stored(links.unionByName(found.where("linked").select("a", "b")))
        entries = _classes(links, entries)
    for low, high, mask in _shares(many):
        if entries.isEmpty():
            break
        pairs = stored(_rest(entries, known, percent, rounds, (F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(mask)).between(low, high - 1)))
        links = stored(links.unionByName(_verified(pairs, texts, words, percent).where("linked").select("a", "b")))
        if high <= mask:
            entries = _classes(links, entries)
    root = components(links)
    group = sets.join(root, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = group.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = group.join(least, "root").select("node", "root", "component_id")
    # rows without a set go with the sets of their doc_id
    bare = own.where("n = 0").drop("node").join(first.select("doc_id", F.col("a").alias("node")), "doc_id", "left")
    out = own.where("n > 0").unionByName(bare).join(known, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root", *keys)


def _own_text(texts: DataFrame, words: int) -> DataFrame:
    """node and text of rows whose text makes the node's set: rows that share a doc_id can have others."""

    def run(batch):
        press = zstandard.ZstdDecompressor()
        node, text = np.asarray(batch.column("node")), batch.column("text")
        good = []
        for i in range(0, len(node), 256):
            raw = [press.decompress(x.as_py()) for x in text[i : i + 256]]
            off = np.append(0, np.cumsum([len(x) for x in raw]))
            good.append(_nodes(*K.sets(*K.shingles(K.Words(np.frombuffer(b"".join(raw), np.uint8), off), words), len(raw)), 1) == node[i : i + 256])
        keep = pa.array(np.concatenate(good))
        yield batch.column("node").filter(keep), text.filter(keep)

    return arrow_map(texts.select("node", "text"), run, "node long, text binary").dropDuplicates(["node"])


def _possible(percent: int, n: str = "n", m: str = "m", pos: str = "pos", at: str = "at") -> Column:
    """Whether sets of n and m tokens with a common token at pos and at can link, given that it is their first."""
    need = _overlap(F.col(n), F.col(m), percent)
    return (F.least(n, m) >= need) & (F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at)) >= need)


def _shares(many: float) -> list[tuple[int, int, int]]:
    """(low, high, mask) of the shares of pairs: hashes under the mask from low to below high. The first is one in `many` or less; together they are all."""
    steps = max(0, math.ceil(math.log(max(many, 1), 4)))
    return [(4**k // 4, 4**k, 4**steps - 1) for k in range(steps + 1)]


def _rest(entries: DataFrame, sets: DataFrame, percent: int, rounds: int, share: Column) -> DataFrame:
    """All pairs (a, b) of different classes in a share that a list can still link, blocks first, then entries by place, parities and answers."""
    bins = math.ceil(math.log(100 / percent) / math.log(BIN)) + 1  # linked sets' sizes differ by a factor of 100 / percent at most
    block = entries.withColumn("size", F.floor(F.log("n") / math.log(BIN)).cast("int")).withColumn("step", F.floor(8 * F.col("pos") / F.col("n") * 5).cast("int"))
    at = ("size", "step", "low", "high", "least", "left")
    of = block.groupBy("token", "size", "step").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("n").alias("least"), F.max(F.col("n") - F.col("pos")).alias("left"))
    one, two = (of.select("token", *(F.col(x).alias(f"{x}{k}") for x in at)) for k in (1, 2))
    need = _overlap(F.col("least1"), F.col("least2"), percent)
    alike = (F.col("low1") == F.col("high1")) & (F.col("low2") == F.col("high2")) & (F.col("low1") == F.col("low2"))
    kept = one.join(two, "token").where(F.struct("size1", "step1") <= F.struct("size2", "step2")).where(F.col("size2") - F.col("size1") <= bins).where(F.least("left1", "left2") >= need).where(~alike)
    kept = kept.select("token", "size1", "step1", "size2", "step2")
    # a pair is made at the first list that it shares: later ones see a common list among those before
    w = Window.partitionBy("node").orderBy("pos", "token")
    before = F.array_compact(F.array(*(F.lag("token", k).over(w) for k in range(1, BEFORE + 1))))
    block = block.withColumn("before_a", before)
    block = stored(block.drop("n").withColumnRenamed("node", "a").join(_sides(sets, rounds, "a")[0], "a"))
    own = [c for c in block.columns if c.endswith("_a")]
    x = block.select("token", F.col("size").alias("size1"), F.col("step").alias("step1"), "a", F.col("class").alias("class_a"), F.col("pos").alias("pos_a"), *own)
    y = block.select("token", F.col("size").alias("size2"), F.col("step").alias("step2"), F.col("a").alias("b"), F.col("class").alias("class_b"), F.col("pos").alias("pos_b"), *(F.col(c).alias(f"{c[:-2]}_b") for c in own))
    pair = kept.join(x, ["token", "size1", "step1"]).join(y, ["token", "size2", "step2"]).where(F.col("class_a") != F.col("class_b")).where(share)
    pair = pair.where(_possible(percent, "n_a", "n_b", "pos_a", "pos_b")).where(_open(percent, rounds)).where(~F.arrays_overlap("before_a", "before_b"))
    return pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of linked ones, that with the smallest id (any id before none), then by a hash.

    Rows without a set are groups by their doc_id, or if that is null by the whole row.
    """
    keyed = with_row_keys(docs)
    with scratch(spark):
        rows = _joined(keyed, WORDS, PERCENT, "row1", "row2")
        alone = F.col("root").isNull()
        group = [F.col("root"), F.when(alone, F.col("doc_id")).alias("id"), F.when(alone & F.col("doc_id").isNull(), F.col("row1")).alias("row")]
        first = rows.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row1", "row2")).alias("at"))
        keep = stored(first.select("at.row1", "at.row2"), keep=True)
    return keyed.join(keep, ["row1", "row2"], "left_semi").dropDuplicates(["row1", "row2"]).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 80 * (ca.n + cb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.root AS component_id
FROM w LEFT JOIN c ON c.doc_id = w.doc_id JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m ON m.doc_id = w.doc_id
"""
