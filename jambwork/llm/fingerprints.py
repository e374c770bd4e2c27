"""Document fingerprints from prefix polynomial hashes.

A text's code points make polynomials modulo two primes of 31 bits. The arrays
of their prefix values answer whether any two spans are equal in constant time,
and so give the longest common extension of two places by binary search.

A fingerprint is a line of the text's length, the values of the whole text, the
values of prefixes at every 2**j-th code point (at most `RUNGS` of them), and a
sketch of the smallest hashes of its spans of `GRAM` code points. Likeness of
two fingerprints is 1 for equal texts, else the larger of the share of the
common prefix that both ladders show and the Jaccard index of the sketches.

Null texts are empty. Two empty texts are alike, an empty one and another are
not. Rows that share a doc_id come in the order of a hash of their texts; null
ids come first.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jambwork.llm import kernels as K
from jambwork.llm.common import arrow_map, parts, stored, table

U64 = np.uint64
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003_137, 1_700_000_227)
GRAM, SKETCH, RUNGS = 16, 32, 32


@lru_cache(8)
def _table(k: int, inverse: bool, size: int) -> np.ndarray:
    p = PRIMES[k]
    out = np.ones(size, U64)
    base, n = pow(BASES[k], -1, p) if inverse else BASES[k], 1
    while n < size:
        out[n : 2 * n] = out[: min(n, size - n)] * U64(pow(base, n, p)) % U64(p)
        n *= 2
    return out


def _powers(k: int, n: int, inverse: bool = False) -> np.ndarray:
    return _table(k, inverse, 1 << max(16, int(n).bit_length()))[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64)


class Prefixes:
    """Prefix values of a text modulo both primes: value[k][i] is that of the first i code points."""

    def __init__(self, points: np.ndarray, after: Prefixes | None = None, keep: int = 0):
        """Of `points`; or of the first `keep` code points of `after` and then those."""
        self.n = keep + len(points)
        self.value = []
        for k, p in enumerate(PRIMES):
            v = np.zeros(self.n + 1, U64)
            if keep:
                v[: keep + 1] = after.value[k][: keep + 1]
            np.cumsum((points + U64(1)) * _powers(k, self.n)[keep:] % U64(p), out=v[keep + 1 :])
            v[keep + 1 :] = (v[keep + 1 :] + v[keep]) % U64(p)
            self.value.append(v)

    def span(self, k: int, start: int, end: int) -> int:
        """The span's value times the start's power."""
        return (int(self.value[k][end]) - int(self.value[k][start])) % PRIMES[k]

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether the spans of a length at i here and at j there are equal, but for a chance of about 2**-60."""
        if i + length > self.n or j + length > other.n:
            return False
        return all(self.span(k, i, i + length) * int(_powers(k, j + 1)[j]) % p == other.span(k, j, j + length) * int(_powers(k, i + 1)[i]) % p for k, p in enumerate(PRIMES))

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension from i here and j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(i, other, j, mid) else (lo, mid - 1)
        return lo

    def grams(self, first: int = 0) -> np.ndarray:
        """Hashes of the spans of GRAM code points from `first` on; of a shorter text, one of the whole."""
        width = min(GRAM, self.n)
        m = self.n - width + 1
        if not self.n or first >= m:
            return np.zeros(0, U64)
        one, two = ((v[first + width :] + U64(p) - v[first:m]) * _powers(k, m, True)[first:] % U64(p) for k, (v, p) in enumerate(zip(self.value, PRIMES, strict=True)))
        return K.mix((one << U64(32)) | two)


def smallest(x: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct values, ascending."""
    some = np.unique(np.partition(x, 4 * SKETCH)[: 4 * SKETCH]) if len(x) > 8 * SKETCH else np.unique(x)
    return (some if len(some) >= SKETCH or len(x) <= 8 * SKETCH else np.unique(x))[:SKETCH]


@dataclass
class Fingerprint:
    n: int
    whole: int
    step: int
    ladder: np.ndarray
    sketch: np.ndarray

    @classmethod
    def of(cls, p: Prefixes, grams: np.ndarray) -> Fingerprint:
        step = 1 << max(0, (max(p.n, 1) - 1) // RUNGS).bit_length()
        at = np.arange(step, p.n + 1, step)
        return cls(p.n, (int(p.value[0][-1]) << 32) | int(p.value[1][-1]), step, (K.mix((p.value[0][at] << U64(32)) | p.value[1][at]) >> U64(40)).astype(np.uint32), (smallest(grams) >> U64(32)).astype(np.uint32))

    def __str__(self) -> str:
        return f"{self.n:x}.{self.whole:016x}.{self.ladder.astype('>u4').tobytes().hex()}.{self.sketch.astype('>u4').tobytes().hex()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, ladder, sketch = text.split(".")
        n = int(n, 16)
        return cls(n, int(whole, 16), 1 << max(0, (max(n, 1) - 1) // RUNGS).bit_length(), *(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in (ladder, sketch)))

    def likeness(self, other: Fingerprint) -> float:
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        step = max(self.step, other.step)
        a, b = (x.ladder[step // x.step - 1 :: step // x.step] for x in (self, other))
        m = min(len(a), len(b))
        same = a[:m] == b[:m]
        common = step * (m if same.all() else int(same.argmin()))
        low = np.union1d(self.sketch, other.sketch)[:SKETCH]
        jaccard = len(np.intersect1d(np.intersect1d(self.sketch, other.sketch), low)) / len(low)
        return max(common / max(self.n, other.n), jaccard)


class Text:
    """A text with its prefix values and fingerprint."""

    def __init__(self, text: str):
        self.text = text
        self.prefixes = Prefixes(code_points(text))
        self.grams = self.prefixes.grams()
        self.print = Fingerprint.of(self.prefixes, self.grams)

    def edited(self, other: Text) -> tuple[str, Fingerprint]:
        """The text with its last quarter replaced by the other's first code points; what is kept is not hashed again."""
        n = len(self.text)
        keep, tail = n - n // 4, other.text[: n // 4]
        if not n // 4:
            return self.text, self.print
        p = Prefixes(code_points(tail), self.prefixes, keep)
        first = max(0, keep - GRAM + 1) if p.n >= GRAM else 0
        return self.text[:keep] + tail, Fingerprint.of(p, np.concatenate([self.grams[:first], p.grams(first)]))


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text (compressed), extra: dealt by ranges of ids and sorted; each range ends with a copy of the next one's first row (extra)."""
    n = parts(docs.sparkSession)
    got = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    bounds = docs.sparkSession.sparkContext.broadcast(np.unique(np.array(got or [], np.int64)))

    def range_of(ids: pa.Array) -> np.ndarray:
        return np.searchsorted(bounds.value, pa.compute.fill_null(ids, -(1 << 63)).to_numpy(zero_copy_only=False), "right").astype(np.int32)

    def number(batch):
        yield range_of(batch.column("doc_id")), batch.column("doc_id")

    def press(batch):
        z = zstandard.ZstdCompressor(level=1)
        yield range_of(batch.column("doc_id")), batch.column("doc_id"), batch.column("turn"), pa.array([z.compress(x.as_buffer()) for x in batch.column("text").cast(pa.binary())], pa.binary())

    schema = "part int, doc_id long, turn long, text binary"
    rows = docs.withColumn("turn", F.xxhash64("text"))
    first = arrow_map(docs.select("doc_id"), number, "part int, doc_id long").groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.bool_or(F.col("doc_id").isNull()).alias("null"))
    first = stored(first.select("part", F.when(~F.col("null"), F.col("doc_id")).alias("first")))
    order = Window.orderBy("part")  # a row for each range
    to = first.select(F.col("part").alias("to"), F.lag("part").over(order).alias("part"), "first", F.max("part").over(Window.partitionBy()).alias("last"))
    to = to.select(F.coalesce("part", "last").alias("part"), F.col("first"))
    heads = arrow_map(rows.join(F.broadcast(to.select("first").distinct()), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi"), press, schema)
    heads = heads.groupBy(F.col("doc_id").alias("first")).agg(F.min(F.struct("turn", "text")).alias("at"))
    extra = to.join(heads, to["first"].eqNullSafe(heads["first"])).select("part", F.lit(None).cast("long").alias("doc_id"), F.col("at.turn").alias("turn"), F.col("at.text").alias("text"), F.lit(True).alias("extra"))
    all_ = arrow_map(rows, press, schema).withColumn("extra", F.lit(False)).unionByName(extra)
    return all_.repartitionById(n, F.col("part")).sortWithinPartitions("part", "extra", "doc_id", "turn").select("doc_id", "text", "extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix (of the text and the edited one)."""
    rows = _ordered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches):
        z, before = zstandard.ZstdDecompressor(), None
        for batch in batches:
            out = []
            for doc, text, extra in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("extra").to_pylist(), strict=True):
                now = Text(z.decompress(text.as_py()).decode())
                if before is not None:
                    own, last = before
                    edited, mark = last.edited(now)
                    near = last.print.likeness(mark)
                    common = len(last.text) if edited == last.text else len(last.text) - len(last.text) // 4
                    common += _common(last.text, edited, common)
                    out.append((own, len(last.text), hashlib.sha256(edited.encode()).hexdigest(), str(last.print), str(mark), near, last.print.likeness(now.print), common))
                before = None if extra else (doc, now)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")


def _common(a: str, b: str, start: int) -> int:
    """Length of the common extension of two strings from a place on, of the tails' prefix values."""
    if start >= min(len(a), len(b)):
        return 0
    return Prefixes(code_points(a[start:])).extension(0, Prefixes(code_points(b[start:])), 0) if a[start] == b[start] else 0


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
