"""Language-model scores by Katz backoff.

A model of n-grams of any order over lower-cased words: Good-Turing discounted
counts of each order, and for each history a backoff weight that makes its
probabilities sum to one exactly. An n-gram that training lacks has its history's
weight times the probability of the n-gram without its first word, and so on down
to the words. Words that training lacks are one type, whose probability is what
the unigram discounts leave. A text begins with one start; a word that has fewer
words before it than a history takes has the longest history there is.

Counts lie in tables partitioned by a hash of the word or of the history, each
partition's in sorted arrays. Documents lie in chunks. Order by order, a chunk asks
each table partition once for the counts of its distinct n-grams, in sorted order;
requests carry the chunk's own training counts, from which the partition makes
its table, and the answers are the counts in the order of the request. With the
answers of the orders below, a chunk knows the probabilities to which its n-grams
fall back, and sends those that training has along, from which the partition sums
up what a history's weight has to leave out. So each
distinct n-gram of a chunk is moved once, packed, and no task holds more than a
chunk or a table partition. Histories that make up more than one in
`HOT` of all tokens are spread over all partitions by the n-gram's hash, and
their sums are added up by the chunks.

Null and empty texts are the end token alone. Rows that share a doc_id are texts
of their own. Without training texts the score is the base score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.llm import kernels as K
from jambwork.llm.common import arrow_map, bucket_of, parts, stored, table

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Order of the query's model.
ORDER = 2
HOT = 500
FOLDS, HELD_OUT = 7, 2
U64 = np.uint64
END, START = U64(0x656E64), U64(0x7374617274)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers or floats as one compressed string, the bytes of equal weight together."""
    press = zstandard.ZstdCompressor(level=1)
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for x in arrays:
        if x.dtype.kind in "iu":
            wide = int(x.max(initial=0)).bit_length() + 7 >> 3
            planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T)
        else:
            wide, planes = -1, x.astype("<f8")
        b = press.compress(planes.tobytes())
        out += [np.array([len(x), wide, len(b)], np.int64).tobytes(), b]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    press, at, out = zstandard.ZstdDecompressor(), 8, []
    for _ in range(int(np.frombuffer(data, np.int64, 1)[0])):
        n, wide, size = np.frombuffer(data, np.int64, 3, at).tolist()
        at += 24
        raw = press.decompress(data[at : at + size]) if n and wide else b""
        at += size
        if wide < 0:
            out.append(np.frombuffer(raw, "<f8"))
            continue
        x = np.zeros((n, 8), np.uint8)
        x[:, :wide] = np.frombuffer(raw, np.uint8).reshape(wide, n).T
        out.append(x.view("<u8").ravel().astype(np.int64))
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class Discounts:
    """Good-Turing discounts d[1..DISCOUNTED] from the number of types that occur 1, 2, .. times; 1 where those don't allow any."""

    def __init__(self, types: np.ndarray):
        n, k = np.append(0.0, types[: DISCOUNTED + 1]), DISCOUNTED
        d = np.ones(k + 1)
        if n[1] > 0:
            last = (k + 1) * n[k + 1] / n[1]
            for r in range(1, k + 1):
                if n[r] > 0 and last < 1:
                    x = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last)
                    d[r] = x if 0 < x < 1 else 1.0
        self.d = d

    def of(self, c: np.ndarray) -> np.ndarray:
        """The discounted counts."""
        return c * self.d[np.where(c > DISCOUNTED, 0, c).astype(np.int64)]


class Unigrams:
    """p(word) from its training count; stats: tokens, types, and types that occur 1 to 6 times."""

    def __init__(self, stats: np.ndarray):
        self.tokens, self.types = float(stats[0]), float(stats[1])
        self.discounts = Discounts(stats[2:])
        kept = self.tokens - (stats[2 : 2 + DISCOUNTED] * np.arange(1, DISCOUNTED + 1) * (1 - self.discounts.d[1:])).sum()
        self.rest = 1 - kept / self.tokens if self.tokens else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        if self.rest < 1e-12 or not self.tokens:
            return (c + 1) / (self.tokens + self.types + 1)
        return np.where(c > 0, self.discounts.of(c) / self.tokens, self.rest)


def backoff(stats: np.ndarray, lower: np.ndarray, d: Discounts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, scale of the discounted counts, total) of histories.

    stats: for each, the number of words that follow it 1 to 5 times and the sum of larger counts; lower: what the
    unigrams give to all words that follow it. A history whose counts leave nothing is given one more count.
    """
    r = np.arange(1, DISCOUNTED + 1)
    total = stats[:, :DISCOUNTED] @ r + stats[:, DISCOUNTED]
    kept = stats[:, :DISCOUNTED] @ (r * d.d[1:]) + stats[:, DISCOUNTED]
    there = np.maximum(total, 1)
    none = (total > 0) & (total - kept < 1e-9 * there)
    scale = np.where(none, 1 / (there + 1), 1 / there)
    rest = np.where(none, 1 / (there + 1), (total - kept) / there)
    return np.where(total > 0, rest / np.maximum(1 - lower, 1e-300), 1.0), scale, total


class Chunk:
    """A chunk's texts as indexes of sorted distinct words."""

    def __init__(self, rows: pa.Table):
        press = zstandard.ZstdDecompressor()
        order = np.lexsort((rows.column("turn").to_numpy(), rows.column("doc_id").fill_null(0).to_numpy()))
        self.ids = rows.column("doc_id").take(pa.array(order))
        train = rows.column("train").to_numpy(zero_copy_only=False)[order]
        texts = rows.column("text").take(pa.array(order))
        words, size, held, total = [], [], [], 0

        def flush():
            w = K.Words(np.frombuffer(b"".join(held), np.uint8), np.append(0, np.cumsum([len(x) for x in held])))
            n = np.diff(w.first)
            h = np.full(len(w.start) + len(n), END)
            h[np.arange(len(w.start)) + w.doc] = w.hashes()
            words.append(h)
            size.append(n + 1)

        for x in texts:
            held.append(press.decompress(x.as_py()))
            total += len(held[-1])
            if total > K.PIECE_BYTES:
                flush()
                held, total = [], 0
        if held:
            flush()
        self.size = np.concatenate(size) if size else np.zeros(0, np.int64)
        self.words, self.token = np.unique(np.concatenate([*words, np.array([START])]), return_inverse=True)
        self.start, self.token = int(self.token[-1]), self.token[:-1]
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.doc)) - (np.cumsum(self.size) - self.size)[self.doc]
        self.train = train[self.doc]


class Grams:
    """A chunk's distinct n-grams of an order: index of the history (an n-gram of the order below), hash, and of, that of each token (-1: none)."""

    def __init__(self, c: Chunk, below: Grams | None = None):
        self.order = below.order + 1 if below else 1
        if not below:
            self.of, self.hash = c.token, c.words
        else:
            at = np.flatnonzero(c.place >= self.order - 2)
            hist = below.of[at - 1]
            if self.order == 2:
                hist = np.where(c.place[at] == 0, c.start, hist)
            key, of = np.unique(hist * len(c.words) + c.token[at], return_inverse=True)
            self.hist, word = np.divmod(key, len(c.words))
            self.of = np.full(len(c.token), -1)
            self.of[at] = of
            self.hash = K.mix(below.hash[self.hist] * U64(3) + c.words[word])
            self.lower = np.empty(len(key), np.int64)  # the n-gram without its first word
            self.lower[of] = below.of[at]
            self.short, self.mixed = (below.hash >> U64(16)).astype(np.int64), (self.hash & U64((1 << 40) - 1)).astype(np.int64)
        self.count = np.bincount(self.of[c.train & (self.of >= 0)], minlength=len(self.hash))

    def asked(self, n: int, hot: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each table partition the histories it is asked for (indexes), the n-grams (indexes), and n-grams by history; all in its order."""
        part = np.where(hot[self.hist], self.mixed, self.short[self.hist]) % n
        order = np.lexsort((self.mixed, self.short[self.hist], part))
        at = np.searchsorted(part[order], np.arange(n + 1))
        everywhere, out = np.flatnonzero(hot), []
        for k in range(n):
            grams = order[at[k] : at[k + 1]]
            hists = np.unique(np.concatenate([self.hist[grams], everywhere]))
            hists = hists[np.argsort(self.short[hists], kind="stable")]
            rank = np.empty(len(self.short), np.int64)
            rank[hists] = np.arange(len(hists))
            out.append((hists, grams, np.bincount(rank[self.hist[grams]], minlength=len(hists))))
        return out


def _answers(answers: pa.Table) -> dict[int, list[np.ndarray]]:
    return {part: _unpack(data) for part, data in zip(answers.column("part").to_pylist(), answers.column("data").to_pylist(), strict=True)}


def _sent(parts_: list[int], chunk: int, data: list[bytes]) -> pa.Table:
    return pa.table({"part": pa.array(parts_, pa.int32()), "chunk": pa.array([chunk] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})


MESSAGE = "part int, chunk int, data binary"


def _totals(chunk: Chunk, answers: dict[int, list[np.ndarray]], n: int) -> np.ndarray:
    total = np.zeros(len(chunk.words), np.int64)
    part = (chunk.words % U64(n)).astype(np.int64)
    for k, (got,) in answers.items():
        total[part == k] = got
    return total


def _stats(messages: DataFrame) -> np.ndarray:
    """The sums of what each table partition says of itself: a few numbers of each."""
    return sum(_unpack(x.data)[0] for x in messages.where("chunk = -1").select("data").toLocalIterator())


class Known:
    """A chunk's n-grams of one order, their counts in training, and p, their probabilities after their histories."""

    def __init__(self, grams: Grams, total: np.ndarray, p: np.ndarray):
        self.grams, self.total, self.p = grams, total, p


class Model:
    """What the chunks know of the whole: unigrams, discounts by order, number of table partitions and of training texts."""

    def __init__(self, unigrams: Unigrams, discounts: dict[int, Discounts], n: int, texts: int):
        self.unigrams, self.discounts, self.n, self.texts = unigrams, discounts, n, texts

    def hot(self, c: Chunk, below: Known) -> np.ndarray:
        """Histories that make up so much of all tokens that they are spread."""
        hot = below.total * HOT > self.unigrams.tokens
        if below.grams.order == 1:
            hot[c.start] = self.texts * HOT > self.unigrams.tokens
        return hot

    def known(self, c: Chunk, answers: pa.Table) -> list[Known]:
        """The chunk's n-grams of each order that has been answered, one from the other: this is the recursion of the backoff."""
        got = {k: _answers(answers.filter(pa.compute.equal(answers.column("kind"), k))) for k in (1, *self.discounts)}
        total = _totals(c, got[1], self.n)
        out = [Known(Grams(c), total, self.unigrams.p(total))]
        for k, d in self.discounts.items():
            below = out[-1]
            g = Grams(c, below.grams)
            stats, lower, count = np.zeros((len(below.total), DISCOUNTED + 1)), np.zeros(len(below.total)), np.zeros(len(g.hist), np.int64)
            for part, (hists, grams, _) in enumerate(g.asked(self.n, self.hot(c, below))):
                counts, each, low = got[k][part]
                count[grams] = counts
                stats[hists] += each.reshape(-1, DISCOUNTED + 1)
                lower[hists] += low
            weight, scale, _ = backoff(stats, lower, d)
            out.append(Known(g, count, np.where(count > 0, d.of(count) * scale[g.hist], weight[g.hist] * below.p[g.lower])))
        return out


def score(docs: DataFrame, train: str = "train", order: int = ORDER) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text, train), by n-grams up to an order of 1 or more."""
    n = parts(docs.sparkSession)

    def press(batch):
        z = zstandard.ZstdCompressor(level=3)
        yield *(batch.column(x) for x in ("chunk", "doc_id", "turn", "train")), pa.array([z.compress(x.as_buffer()) for x in batch.column("text").cast(pa.binary())], pa.binary())

    turn = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(train).alias("train"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", turn), F.lit(n)).cast("int").alias("chunk"), "doc_id", turn.alias("turn"), "train", "text")
    rows = arrow_map(rows, press, "chunk int, doc_id long, turn long, train boolean, text binary")
    of_chunk = rows.groupBy("chunk")

    def ask_words(table_: pa.Table) -> pa.Table:
        c = Chunk(table_)
        count, part, data = Grams(c).count, (c.words % U64(n)).astype(np.int64), []
        for k in range(n):
            data.append(_pack(_deltas(c.words[part == k]), count[part == k]))
        return _sent([*range(n)], table_.column("chunk")[0].as_py(), data)

    def serve_words(asked: pa.Table) -> pa.Table:
        got = [_unpack(x) for x in asked.column("data").to_pylist()]
        keys = [np.cumsum(x.view(U64), dtype=U64) for x, _ in got]
        word, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([c for _, c in got]), len(word)).astype(np.int64)
        cut = np.cumsum([len(x) for x in keys])[:-1]
        types = np.bincount(total[total <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:]
        part = asked.column("part")[0].as_py()
        answers = [_pack(x) for x in np.split(total[inverse], cut)]
        return pa.table({"part": pa.array([part] * (len(got) + 1), pa.int32()), "chunk": pa.array([*asked.column("chunk").to_pylist(), -1], pa.int32()), "data": pa.array([*answers, _pack(np.concatenate([[total.sum(), (total > 0).sum()], types]))], pa.binary())})

    words = stored(of_chunk.applyInArrow(ask_words, MESSAGE).groupBy("part").applyInArrow(serve_words, MESSAGE))
    stats = _stats(words) if not words.isEmpty() else np.zeros(2 + DISCOUNTED + 1)
    unigrams = Unigrams(np.asarray(stats))
    texts = docs.where(F.col(train)).count()

    def ask_grams(model: Model):
        def ask(table_: pa.Table, answers: pa.Table) -> pa.Table:
            c = Chunk(table_)
            below = model.known(c, answers)[-1]
            g, data = Grams(c, below.grams), []
            back = below.total if below.grams.order == 1 else below.p  # words' counts say their probabilities, in fewer bytes
            back = np.where(g.count > 0, back[g.lower], 0)
            for hists, grams, many in g.asked(n, model.hot(c, below)):
                data.append(_pack(_deltas(g.short[hists]), many, g.mixed[grams], g.count[grams], back[grams]))
            return _sent([*range(n)], table_.column("chunk")[0].as_py(), data)

        return ask

    def serve_grams(asked: pa.Table) -> pa.Table:
        got = [_unpack(x) for x in asked.column("data").to_pylist()]
        hists = [np.cumsum(x[0]) for x in got]
        hist, where = np.unique(np.concatenate(hists), return_inverse=True)
        where = np.split(where, np.cumsum([len(x) for x in hists])[:-1])
        h = np.concatenate([np.repeat(w, x[1]) for w, x in zip(where, got, strict=True)])
        mixed, count, back = (np.concatenate([x[k] for x in got]) for k in (2, 3, 4))
        order = np.lexsort((mixed, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (mixed[order][1:] != mixed[order][:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        total = np.bincount(of, count, int(new.sum())).astype(np.int64)
        ph = h[order][new]
        back = np.maximum.reduceat(back[order], np.flatnonzero(new)) if len(order) else back
        back = unigrams.p(back) if back.dtype.kind in "iu" else back
        seen = total > 0
        few = seen & (total <= DISCOUNTED)
        each = np.zeros((len(hist), DISCOUNTED + 1), np.int64)
        np.add.at(each, (ph[few], total[few] - 1), 1)
        each[:, DISCOUNTED] = np.bincount(ph[seen & ~few], total[seen & ~few], len(hist))
        lower = np.bincount(ph[seen], back[seen], len(hist))
        answers = [_pack(t, each[w].ravel(), lower[w]) for t, w in zip(np.split(total[of], np.cumsum([len(x[2]) for x in got])[:-1]), where, strict=True)]
        types = np.bincount(total[seen & (total <= DISCOUNTED + 1)], minlength=DISCOUNTED + 2)[1:]
        part = asked.column("part")[0].as_py()
        return pa.table({"part": pa.array([part] * (len(got) + 1), pa.int32()), "chunk": pa.array([*asked.column("chunk").to_pylist(), -1], pa.int32()), "data": pa.array([*answers, _pack(types)], pa.binary())})

    discounts: dict[int, Discounts] = {}
    answers = words.where("chunk >= 0").withColumn("kind", F.lit(1))
    for k in range(2, order + 1):
        ask = ask_grams(Model(unigrams, dict(discounts), n, texts))
        grams = stored(of_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(ask, MESSAGE).groupBy("part").applyInArrow(serve_grams, MESSAGE))
        discounts[k] = Discounts(np.asarray(_stats(grams) if not grams.isEmpty() else np.zeros(DISCOUNTED + 1), float))
        answers = answers.unionByName(grams.where("chunk >= 0").withColumn("kind", F.lit(k)))
    model = Model(unigrams, discounts, n, texts)

    def evaluate(table_: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(table_)
        known = model.known(c, answers)
        total, p = known[0].total, np.zeros(len(c.token))
        for x in known:  # of each token the highest order it has
            has = x.grams.of >= 0
            p[has] = x.p[x.grams.of[has]]
        docs_ = len(c.size)
        log = np.log10(np.maximum(p, 1e-300))
        base = np.log10((total + 1) / (unigrams.tokens + unigrams.types + 1))[c.token]
        return pa.table({"doc_id": c.ids, "n_tokens": c.size, "n_known": np.bincount(c.doc, total[c.token] > 0, docs_).astype(np.int64), "train_tokens": np.full(docs_, int(unigrams.tokens)), "base_score": np.bincount(c.doc, base, docs_), "score": np.bincount(c.doc, log, docs_)})

    return of_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(evaluate, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of("doc_id", FOLDS) == HELD_OUT
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("train", ~F.coalesce(held_out, F.lit(False)))
    return score(docs).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
