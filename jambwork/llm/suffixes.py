"""Removal of repeated long substrings with run-length BWT indexes.

A byte goes if a string of `length` bytes that covers it starts anywhere else,
in its own or another text. Texts count as bytes; matches don't cross texts.

Which windows (the strings of `length` bytes) can be equal is settled first:
each window's anchor is its k-byte string with the smallest hash, and equal
windows have equal anchors at equal offsets. Runs of windows with one anchor
are cut out as one string, and only where the anchor's hash occurs again. The
strings go to index partitions by anchor, so a partition holds all occurrences
of its windows, and no other text has to be compared.

In a partition, strings are gathered to indexes of a few megabytes. An index is
the run-length compressed Burrows-Wheeler transform of its distinct strings,
with longest common prefixes sampled at the ends of its runs. The matching
statistics of all positions are streamed from these samples, each the one
before less one, and mark the windows that match over their whole length.

Anchors that more than `hot` windows' runs share are not indexed in one task:
their windows are matched one by one, by 128-bit hashes that are counted before
they are moved. That is exact too, and the same at any size.

Texts that are equal as a whole are indexed once. Null texts are empty; texts
shorter than `length` keep all bytes. Rows that share a doc_id, or have none, are
texts of their own. Texts above 12 MB are cut to runs slice by slice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.llm import kernels as K
from jambwork.llm.common import arrow_map, parts, stored, table, with_groups

LENGTH, ANCHOR = 200, 64
#: Runs of windows that one anchor may have in one index; bytes that are indexed at once.
HOT, INDEX_BYTES = 20_000, 1 << 20
U64 = np.uint64


def _grams(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each of the first len - k + 1 positions."""
    p, q = K.powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * p[:-1], out=total[1:])
    m = len(buf) - k + 1
    return K.mix((total[k:] - total[:m]) * q[:m]) if m > 0 else np.zeros(0, U64)


def _runs(buf: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window's start in the text, number of windows, anchor's hash) of runs with one anchor."""
    g = _grams(buf, k)
    n = len(buf) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64)
    key = (g >> U64(24) << U64(24)) | np.arange(len(g), dtype=U64)  # pieces are below 2**24 bytes, or one text
    width = length - k + 1
    low, have = key, 1
    while have < width:
        step = min(have, width - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    at = (low[:n] & U64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    good = off[1:][text] - np.arange(n) >= length
    new = good.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~good[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    stop = good.copy()
    stop[:-1] &= new[1:] | ~good[1:]
    last = np.flatnonzero(stop)
    return text[first], first - off[text[first]], last - first + 1, g[at[first]]


def _anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """anchor, text, at (first window's start and number of windows, packed); a task passes over copies of a text that it has seen."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = np.asarray(batch.column("text_id"))
            fresh = np.array([x not in seen and not seen.add(x) for x in ids.tolist()], bool)
            batch, ids = batch.filter(pa.array(fresh)), ids[fresh]
            for i, buf, off in K.pieces(K.strings(batch.column("text"))):
                for lo, hi in _slices(buf, length):  # windows of one very long text lie in one slice each
                    part = off if hi - lo == len(buf) else np.array([0, hi - lo])
                    d, start, n, h = _runs(buf[lo:hi], part, length, k)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[i + d]), pa.array(((start + lo) << 20) | n)], names=["anchor", "text_id", "at"])

    return docs.select("text_id", "text").mapInArrow(run, "anchor long, text_id long, at long")


def _slices(buf: np.ndarray, length: int, most: int = 12 << 20):
    if len(buf) <= most:
        yield 0, len(buf)
        return
    for lo in range(0, len(buf) - length + 1, most):
        yield lo, min(len(buf), lo + most + length - 1)


class RunLengthIndex:
    """Run-length BWT of some byte strings, with samples at its run ends."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        n = len(buf)
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))
        self.left = off[1:][text] - np.arange(n)  # bytes to the end of the string
        padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(U64)
        self.key = np.zeros(n, U64)
        for j in range(7):
            self.key = (self.key << U64(8)) | np.where(self.left > j, padded[j : j + n], U64(0))
        self.key = (self.key << U64(8)) | np.minimum(self.left, 7).astype(U64)
        self.suffixes = self._sorted(off)
        before = buf[self.suffixes - 1].astype(np.int64)
        starts = np.zeros(n, bool)
        starts[off[:-1]] = True
        bwt = np.where(starts[self.suffixes], -1 - text[self.suffixes], before)  # each string begins with a mark of its own
        self.heads = np.flatnonzero(np.diff(bwt, prepend=bwt[:1] - 1000 - n))
        self.runs = bwt[self.heads]

    def _sorted(self, off: np.ndarray) -> np.ndarray:
        """Suffixes in order, by prefix doubling of those that are still equal; strings' ends come first, in order."""
        n, width, longest = len(self.key), 7, int(np.diff(off).max(initial=0))
        order = np.argsort(self.key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = self.key[order][1:] != self.key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        while width < longest:
            open_ = ~(new & np.append(new[1:], True))
            at = np.flatnonzero(open_)
            if not len(at):
                break
            some = order[at]
            after = np.zeros(len(some), np.int64)
            more = self.left[some] > width
            after[more] = rank[some[more] + width] + 1
            pair = (rank[some] << 32) | after
            o = np.argsort(pair, kind="stable")
            order[at], pair = some[o], pair[o]
            first = np.ones(len(at), bool)
            first[1:] = pair[1:] != pair[:-1]
            rank[order[at]] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            new[at] = first
            width *= 2
        return order

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes i and j."""
        most = np.minimum(self.left[i], self.left[j])
        out, live = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(live):
            a, b = self.key[i[live] + out[live]], self.key[j[live] + out[live]]
            differ = (a ^ b) >> U64(8)
            lead = np.where(differ == 0, 7, (55 - np.floor(np.log2(np.maximum(differ, U64(1)).astype(np.longdouble)))).astype(np.int64) // 8)
            out[live] += lead
            live = live[(lead == 7) & (out[live] < most[live])]
        return np.minimum(out, most)

    def matching(self) -> np.ndarray:
        """For each position the longest match of its suffix with another: from the samples at both ends of the runs."""
        n = len(self.suffixes)
        best = np.zeros(n, np.int64)
        inner = self.heads[1:]
        value = self.common(self.suffixes[inner - 1], self.suffixes[inner])
        for at, v in ((self.suffixes[self.heads], np.append(0, value)), (self.suffixes[np.append(inner - 1, n - 1)], np.append(value, 0))):
            sample = np.full(n, -1, np.int64)
            sample[at] = v
            last = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), 0))
            best = np.maximum(best, sample[last] - (np.arange(n) - last))
        return best


def _marked(strings: pa.Array, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of windows in the strings that occur more than once among them."""
    coded = strings.dictionary_encode()
    code, texts = np.asarray(coded.indices), coded.dictionary.cast(pa.large_binary())
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
    copies = np.bincount(code, minlength=len(texts))
    of = np.zeros(len(texts), np.int64)
    of[code] = anchor
    _, group, kinds = np.unique(of, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(kinds[group] > 1)
    first, last, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    alone = np.flatnonzero(copies > 1)
    first.append(np.zeros(len(alone), np.int64))
    last.append(size[alone] - length)
    owner.append(alone)
    at = 0
    mixed = mixed[np.argsort(of[mixed], kind="stable")]
    mixed_size, groups = np.cumsum(size[mixed]), of[mixed]
    while at < len(mixed):  # an index for some whole groups
        to = int(np.searchsorted(mixed_size, (mixed_size[at - 1] if at else 0) + INDEX_BYTES, "right"))
        to = int(np.searchsorted(groups, groups[min(max(to, at + 1), len(mixed)) - 1], "right"))
        ids = mixed[at:to]
        some = texts.take(pa.array(ids))
        off = np.append(0, np.cumsum(size[ids]))
        buf = np.frombuffer(b"".join(some.to_pylist()), np.uint8)
        long = RunLengthIndex(buf, off).matching() >= length
        own = np.repeat(np.arange(len(ids)), size[ids])
        edge = np.diff(np.concatenate([[0], long.astype(np.int8), [0]]))
        edge_at = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        w = own[edge_at[0]]
        fresh = copies[ids[w]] == 1
        owner.append(ids[w][fresh])
        first.append((edge_at[0] - off[w])[fresh])
        last.append((edge_at[1] - off[w])[fresh])
        at = to
    owner, first, last = (np.concatenate(x) for x in (owner, first, last))
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    many = np.diff(begin)[code]
    row = np.repeat(np.arange(len(code)), many)
    j = order[np.repeat(begin[:-1][code], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    return row, first[j], last[j]


def _indexed(strings: DataFrame, length: int) -> DataFrame:
    """Repeated byte ranges (text_id, check, lo, hi), from strings that lie together by anchor."""

    def run(batches):
        held, size = [], 0
        done = pa.schema([("text_id", pa.int64()), ("check", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

        def found(t: pa.Table):
            t = t.combine_chunks()
            b = t.to_batches()[0]
            row, first, last = _marked(b.column("string"), np.asarray(b.column("anchor")), length)
            start = np.asarray(b.column("start"))[row]
            at = pa.array(row)
            return pa.RecordBatch.from_arrays([b.column("text_id").take(at), b.column("check").take(at), pa.array((start + first).astype(np.int32)), pa.array((start + last + length).astype(np.int32))], schema=done)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("string").nbytes
            if size > 4 * INDEX_BYTES:
                t = pa.Table.from_batches(held)
                anchor = t.column("anchor").to_numpy()
                whole = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                if whole:
                    yield found(t.slice(0, whole))
                    held = t.slice(whole).to_batches()
                    size = sum(x.column("string").nbytes for x in held) // 8
                else:
                    size = 0
        if held:
            yield found(pa.Table.from_batches(held))

    return strings.mapInArrow(run, "text_id long, check long, lo int, hi int")


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(keys, cut): docs with the two hashes of their text; and text_id, check, n_bytes, n_removed, n_spans, kept (binary) of each text."""
    text = F.coalesce("text", F.lit(""))
    keys = docs.withColumn("text", text).withColumn("text_id", F.xxhash64("text")).withColumn("check", F.xxhash64("text", F.lit(1)))
    n = parts(docs.sparkSession)
    anchors = with_groups(_anchors(keys, length, anchor), ["anchor"], F.count("*").alias("c")).where("c > 1")
    hits = stored(anchors.withColumn("hot", F.col("c") > hot).groupBy("text_id").agg(F.collect_set(F.struct("anchor", "at", "hot")).alias("hits")))

    def press(batches):
        """Each text of a task once, compressed, and at its end how many more copies the task has."""
        z, more = zstandard.ZstdCompressor(level=1), {}
        names = ["text_id", "check", "text", "copies"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            ids = [*zip(batch.column("text_id").to_pylist(), batch.column("check").to_pylist(), strict=True)]
            fresh = []
            for x in ids:
                fresh.append(x not in more)
                more[x] = more.get(x, -1) + 1
            got = batch.filter(pa.array(fresh, pa.bool_()))
            text = pa.array([z.compress(x.as_buffer()) for x in got.column("text").cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([got.column("text_id"), got.column("check"), text, pa.array([1] * got.num_rows, pa.int64())], names=names)
        rest = [(*x, None, n) for x, n in more.items() if n]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rest, strict=True), types, strict=True)], names=names)

    pressed = keys.select("text_id", "check", "text").mapInArrow(press, "text_id long, check long, text binary, copies long").repartition(n, "text_id")
    texts = pressed.groupBy("text_id", "check").agg(F.first("text", ignorenulls=True).alias("text"), F.sum("copies").alias("copies"))
    held = texts.join(hits, "text_id")

    def strings(batch):
        z, lists = zstandard.ZstdDecompressor(), batch.column("hits")
        row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(lists)))
        flat = lists.flatten()
        h, at, hot = (np.asarray(flat.field(x)) for x in ("anchor", "at", "hot"))
        start, m = at >> 20, at & 0xFFFFF
        end = start + m + length - 1
        cut, last, own = [], -1, b""
        for r, a, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
            if r != last:
                last, own = r, z.decompress(batch.column("text")[r].as_py())
            cut.append(own[a:e])
        ids, checks = batch.column("text_id"), batch.column("check")
        for lo in range(0, len(row), 20_000):
            s = slice(lo, lo + 20_000)
            i = pa.array(row[s])
            yield h[s], hot[s], ids.take(i), checks.take(i), start[s].astype(np.int32), pa.array(cut[s], pa.binary())

    cut_out = arrow_map(held.select("text_id", "check", "text", "hits"), strings, "anchor long, hot boolean, text_id long, check long, start int, string binary")
    cool = cut_out.where("not hot").drop("hot").repartition(n, "anchor").sortWithinPartitions("anchor")
    ranges = _indexed(cool, length).unionByName(_one_by_one(held, length))
    ranges = ranges.groupBy("text_id", "check").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return keys, _cut(texts.join(ranges, ["text_id", "check"], "left"), length)


def _one_by_one(held: DataFrame, length: int) -> DataFrame:
    """Repeated ranges among the windows of anchors that are too frequent for one index."""
    some = held.select("text_id", "check", "text", F.filter("hits", lambda x: x["hot"]).alias("hits")).where(F.size("hits") > 0)

    def windows(batch):
        z, lists = zstandard.ZstdDecompressor(), batch.column("hits")
        for r, (t, hits) in enumerate(zip(batch.column("text"), lists.to_pylist(), strict=True)):
            buf = np.frombuffer(z.decompress(t.as_py()), np.uint8)
            one, two = _grams(buf, length), _grams(buf[::-1], length)[::-1]
            at = np.concatenate([np.arange(x["at"] >> 20, (x["at"] >> 20) + (x["at"] & 0xFFFFF)) for x in hits])
            same = pa.array(np.full(len(at), r))
            yield batch.column("text_id").take(same), batch.column("check").take(same), at.astype(np.int32), one[at].view(np.int64), two[at].view(np.int64)

    w = arrow_map(some, windows, "text_id long, check long, at int, w1 long, w2 long")
    twice = w.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    return w.join(twice, ["w1", "w2"]).select("text_id", "check", F.col("at").alias("lo"), (F.col("at") + length).cast("int").alias("hi"))


def _cut(texts: DataFrame, length: int) -> DataFrame:
    def run(batch):
        z, out = zstandard.ZstdDecompressor(), []
        for text, copies, ranges in zip(batch.column("text"), batch.column("copies").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            b = z.decompress(text.as_py())
            if copies > 1 and len(b) >= length:
                out.append((len(b), len(b), 1, b""))
                continue
            kept, at, removed, spans = [], 0, 0, 0
            for x in sorted(ranges or [], key=lambda x: (x["lo"], x["hi"])):
                lo, hi = x["lo"], x["hi"]
                if hi <= at:
                    continue
                if lo > at or not spans:
                    kept.append(b[at:lo])
                    spans += 1
                removed += hi - max(lo, at)
                at = hi
            kept.append(b[at:])
            out.append((len(b), removed, spans, b"".join(kept)))
        cols = [*zip(*out, strict=True)]
        yield batch.column("text_id"), batch.column("check"), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in cols[3]])

    return arrow_map(texts.select("text_id", "check", "text", "copies", "ranges"), run, "text_id long, check long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    keys, cut = repeats(docs)
    return keys.select("doc_id", "text_id", "check").join(cut.drop("kept"), ["text_id", "check"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated bytes go from each text, and characters that a cut has split. All rows stay, those that are empty then and those without a doc_id, too."""
    keys, cut = repeats(docs)
    kept = cut.select("text_id", "check", F.try_validate_utf8(F.col("kept").cast("string")).alias("whole"), "kept", "n_removed")
    text = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(F.coalesce("whole", F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\uFFFD", "")))
    out = keys.drop("text").join(kept.select("text_id", "check", text.alias("text")), ["text_id", "check"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
