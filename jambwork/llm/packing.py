"""Packing by lexical retrieval: windows of related documents.

Documents are tokenised once. A range partitioning by a min-hash of their token
trigrams puts documents with common passages side by side; many with the same
hash are spread by a hash of their ids. Each partition is cut into shards of
bounded size. A shard has a BM25 inverted index over token ids: the open window
asks it for the neighbours of its seed document, by all of the seed's terms, and
takes unused ones, best first, until it is full. The document that
crosses the window's end is cut there and its rest is the next window's seed.

So all windows of a partition are full but for the last one, which is split
into sequences whose lengths are powers of two and need no padding.

Null texts are empty: the end id alone. Rows that share a doc_id, or have none,
are documents of their own. Nothing is dropped or cut short.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.llm import kernels as K
from jambwork.llm import tokens
from jambwork.llm.common import arrow_map, parts, stored, table

WINDOW, END = 1024, 0
#: Bounds of a shard.
SHARD_DOCS, SHARD_TOKENS = 1024, 1_500_000
K1, B = 1.2, 0.75
#: Characters that are encoded at once.
AT_ONCE = 1 << 20
U64 = np.uint64


def tokenised(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """doc_id, route (min-hash of token trigrams) and ids (compressed unsigned 16-bit ids, the end id included)."""

    def run(batch):
        texts, ids = K.strings(batch.column("text")).to_pylist(), batch.column("doc_id")
        encode, press = tokens.byte_pairs(vocabulary), zstandard.ZstdCompressor(level=1)
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                size += len(texts[to])
                to += 1
            flat, off = tokens.joined([x + [end] for x in encode(texts[at:to])])
            g = K.ngrams(flat.astype(U64), 3)
            g = np.append(g, np.full(len(flat) - len(g), 1 << 63, U64))
            route = K.mix(np.minimum.reduceat(g, off[:-1]))
            flat = flat.astype("<u2")
            yield ids.slice(at, to - at), route.view(np.int64), pa.array([press.compress(flat[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
            at = to

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, route long, ids binary")


class Bm25:
    """Inverted index of a shard: weights of (term, document) postings, by term."""

    def __init__(self, flat: np.ndarray, off: np.ndarray):
        n, size = len(off) - 1, np.diff(off)
        key = (np.repeat(np.arange(n), size).astype(U64) << U64(16)) | flat.astype(U64)
        key, tf = np.unique(key, return_counts=True)
        self.doc, term = (key >> U64(16)).astype(np.int32), (key & U64(0xFFFF)).astype(np.int32)
        df = np.bincount(term, minlength=1 << 16)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / max(size.mean(), 1)))
        self.n = n
        self.terms, self.at = term, np.searchsorted(self.doc, np.arange(n + 1))
        by = np.argsort(term, kind="stable")
        self.posting, self.value = self.doc[by], weight[by]
        self.begin = np.append(0, np.cumsum(df))

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Documents that are still free, by falling score for the seed's terms; ties by place."""
        t = self.terms[self.at[seed] : self.at[seed + 1]]
        lo, size = self.begin[t], self.begin[t + 1] - self.begin[t]
        i = np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        score = np.bincount(self.posting[i], self.value[i], self.n)
        open_ = np.flatnonzero(free)
        return open_[np.argsort(-score[open_], kind="stable")]


class Packer:
    """Fills windows one after another; keeps the open one between shards."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.used = window, first_sequence, 0
        self.open: list[list[int]] = []  # pieces of the open window: row, start, length
        self.done: list[tuple[int, int, int, int, int]] = []

    def put(self, row: int, size: int) -> None:
        start = 0
        while start < size:
            take = min(self.window - self.used, size - start)
            self.open.append([row, start, take])
            self.used += take
            start += take
            if self.used == self.window:
                self.close()

    def close(self) -> None:
        at = 0
        for row, start, take in self.open:
            self.done.append((row, start, take, self.sequence, at))
            at += take
        self.open, self.used = [], 0
        self.sequence += 1

    def end(self) -> None:
        """The open window as sequences of powers of two."""
        left, self.open, rest = self.open, [], self.used
        self.used = 0
        while left:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            while room:
                row, start, have = left[0]
                take = min(room, have)
                self.open.append([row, start, take])
                left[0] = [row, start + take, have - take]
                if take == have:
                    left.pop(0)
                room -= take
            self.close()

    def shard(self, sizes: list[int], base: int, index: Bm25) -> None:
        free = np.ones(len(sizes), bool)
        for seed in range(len(sizes)):
            if not free[seed]:
                continue
            free[seed] = False
            self.put(base + seed, sizes[seed])
            now = seed
            while self.used and free.any():
                began = self.sequence
                for d in index.neighbours(now, free):
                    free[d] = False
                    self.put(base + int(d), sizes[d])
                    if self.sequence != began:  # the window is full, and the next one's seed is what was cut
                        now = int(d)
                        break


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids where asked for."""
    spark = docs.sparkSession
    rows = stored(tokenised(docs, vocabulary, end))
    salt = F.xxhash64("doc_id")
    rows = rows.withColumn("salt", salt).repartitionByRange(parts(spark), "route", "salt").sortWithinPartitions("route", "salt", "doc_id")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches):
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        held: dict[int, tuple[int, np.ndarray]] = {}  # rows with pieces that have not left yet
        count, shard, size = 0, [], 0
        press = zstandard.ZstdDecompressor()

        def flush():
            nonlocal count, shard, size
            off = np.append(0, np.cumsum([len(x) for _, x in shard]))
            index = Bm25(np.concatenate([x for _, x in shard]), off)
            held.update((count + i, x) for i, x in enumerate(shard))
            packer.shard([len(x) for _, x in shard], count, index)
            count, shard, size = count + len(shard), [], 0
            return out()

        def out():
            done, packer.done = packer.done, []
            ids = [held[row][1][a : a + n].astype("<u4") for row, a, n, _, _ in done]
            cols = [
                pa.array([held[x[0]][0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([len(held[x[0]][1]) for x in done], pa.int64()), pa.array([x[3] for x in done], pa.int64()), pa.array([x[4] for x in done], pa.int64()),
            ]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            keep = {x[0] for x in packer.open}
            for row in [x for x in held if x not in keep]:
                del held[row]
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for doc, b in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                x = np.frombuffer(press.decompress(b), "<u2")
                if shard and (len(shard) == SHARD_DOCS or size + len(x) > SHARD_TOKENS):
                    yield flush()
                shard.append((doc, x))
                size += len(x)
        if shard:
            yield flush()
        packer.end()
        yield out()

    return rows.select("doc_id", "ids").mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of packed sequences; of rows without a doc_id, too."""
    return pack(docs, tokens.public("byte_bpe_50k.json"))
