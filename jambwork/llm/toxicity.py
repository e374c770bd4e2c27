"""Toxicity by class-conditional Kneser-Ney models.

One Kneser-Ney bigram model of all labelled text is shared: discounted counts,
and a backoff to continuation counts (of how many words a word comes after).
Each class, toxic and ordinary text, has a model of its own that backs off to it:

* words: what the class's texts have of a word beyond its discount, and for the
  rest the shared continuation probability. Beyond it have to be both the texts
  with the word and the words that it comes after, so copies of a text don't
  make their words telling;
* bigrams: what the class's texts have of a bigram beyond its discount, and for
  the rest the shared discounted count and the class's word probability.

A discount is what the shared counts let expect in the class, `SHARE` of what both
classes have beyond that, and `ERRORS` standard errors. So an expression of few texts, or one that both classes use
alike, gets its probability from the shared counts and tells nothing. Both
models sum to one over all words and one type for unknown ones. A text's score
is the logistic of the difference of both log-likelihoods per token, with the
two coefficients fitted on labelled texts that the counted ones don't contain.

The models are fitted on a bounded sample of the labelled rows: at most
`max_docs` of each class, whole texts in the order of a hash of their id. Words
and bigrams of fewer than `LEAST` texts count as unknown, or as unseen. So what
each task gets is bounded by a parameter, whatever the size of the corpus;
scoring is one pass over the documents without a shuffle.

Null and empty texts have no token, hence a difference of 0 and the score of the
intercept, below 0.5. Labels other than 0 and 1 are passed over. Of a document
with several labels each label counts. Without labels of both classes the score
is 0 for all. Rows without a doc_id are scored and aren't held out. Repeated
rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.llm import kernels as K
from jambwork.llm.common import arrow_map, bucket_of, stored, table

MAX_DOCS = 8_000
#: Texts that an n-gram needs to be kept; counts that complete a history's.
LEAST, STRENGTH = 4, 3.0
#: Discounts beyond the expected count: a share of what both classes have beyond it, and so many standard errors.
SHARE, ERRORS = 0.2, 3.0
#: Weight of the prior slope, in texts.
PRIOR = 0.003
U64 = np.uint64
START = U64(0x1234567)


def _pairs(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(history, word) hashes of each token; the first word's history is START."""
    w = words.hashes()
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[words.first[:-1][np.diff(words.first) > 0]] = START
    return h, w


def _beyond(c: np.ndarray, expected: np.ndarray, both: np.ndarray) -> np.ndarray:
    """A class's counts less their discounts, by what is expected of it and what both classes have."""
    return np.maximum(c - expected - SHARE * np.maximum(both[:, None] - expected, 0) - ERRORS * np.sqrt(expected), 0)


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of keys in a sorted array, -1 where it lacks them."""
    if not len(keys):
        return np.full(len(wanted), -1)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, i, -1)


@dataclass
class Models:
    """Both class models (0 and 1 of the last axis: ordinary, toxic), by sorted keys; the last row of each table is for unknown ones.

    word: P(word) of each class; back, left: of a history, the shared weight of its backoff and the class's weight of
    what is shared; direct, own: of a bigram, the shared and the class's discounted shares.
    """

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    word: np.ndarray = field(default_factory=lambda: np.ones((1, 2)))
    hists: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    back: np.ndarray = field(default_factory=lambda: np.ones(1))
    left: np.ndarray = field(default_factory=lambda: np.ones((1, 2)))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    direct: np.ndarray = field(default_factory=lambda: np.zeros(1))
    own: np.ndarray = field(default_factory=lambda: np.zeros((1, 2)))
    slope: float = 0.0
    intercept: float = -30.0

    @classmethod
    def fit(cls, words, hist, pairs, total: np.ndarray, types: np.ndarray, discount: float) -> Models:
        """Data frames of kept words (w, ordinary, toxic, types, after_ordinary, after_toxic), histories (h, ..) and bigrams (h, w, ..).

        total and types: bigrams of texts and kinds of bigrams of each class, and types' last number those of both.
        """
        words, hist = words.sort_values("w"), hist.sort_values("h")
        both, end = ["ordinary", "toxic"], lambda x, v: np.append(x, np.full((1, *x.shape[1:]), v), 0)
        w, h = words["w"].to_numpy(U64), hist["h"].to_numpy(U64)
        c, follows = words[both].to_numpy(float), words["types"].to_numpy(float)
        after = words[["after_ordinary", "after_toxic"]].to_numpy(float)
        continued = np.maximum(follows - discount, 0) / types[2]
        continued = np.append(continued, max(1 - continued.sum(), 1e-12))
        texts = _beyond(c, c.sum(1, keepdims=True) * total / total.sum(), c.sum(1)) / total
        beyond = np.minimum(texts, _beyond(after, follows[:, None] * types[:2] / types[2], follows) / types[:2])
        word = end(beyond, 0.0) + (1 - beyond.sum(0)) * continued[:, None]

        ph, pw, pc = pairs["h"].to_numpy(U64), pairs["w"].to_numpy(U64), pairs[both].to_numpy(float)
        i, j, n = _at(w, pw), _at(h, ph), len(h)
        hc = hist[both].to_numpy(float)
        direct = np.maximum(pc.sum(1) - discount, 0) / hc.sum(1)[j]
        back = 1 - np.bincount(j, direct, n)
        shared = direct[:, None] + back[j, None] * word[i]
        own = _beyond(pc, hc[j] * shared, pc.sum(1)) / (hc[j] + STRENGTH)
        left = 1 - np.stack([np.bincount(j, own[:, k], n) for k in (0, 1)], 1)
        key = K.mix(ph * U64(3) + pw)
        order = np.argsort(key)
        return cls(w, word, h, end(back, 1.0), end(left, 1.0), key[order], end(direct[order], 0.0), end(own[order], 0.0))

    def probabilities(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """P(word | history) by the ordinary and the toxic model, for arrays of hashes; of an unknown history, P(word)."""
        i, j, k = _at(self.words, w), _at(self.hists, h), _at(self.pairs, K.mix(h * U64(3) + w))
        return self.own[k] + self.left[j] * (self.direct[k][:, None] + self.back[j, None] * self.word[i])

    def difference(self, words: K.Words) -> np.ndarray:
        """log P(text | toxic) - log P(text | ordinary) per token, for each text."""
        n = len(words.first) - 1
        p = np.log(np.maximum(self.probabilities(*_pairs(words)), 1e-300))
        return np.bincount(words.doc, p[:, 1] - p[:, 0], n) / np.maximum(np.diff(words.first), 1)

    def score(self, words: K.Words) -> np.ndarray:
        z = self.slope * self.difference(words) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with halved steps, on standardised x.

    A prior of `PRIOR` texts' weight holds the standardised slope near 1, so that few texts can't turn it round.
    """
    if not len(x) or y.min() == y.max():
        return 0.0, -30.0
    m, s = x.mean(), x.std() or 1.0
    a = np.stack([(x - m) / s, np.ones(len(x))], 1)
    b, mean, weight = np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([PRIOR, 1e-3])
    loss = lambda b: np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ b)).sum() + (weight * (b - mean) ** 2).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(weight), a.T @ (y - p) - weight * (b - mean))
        while abs(step).max() > 1e-9 and loss(b + step) > loss(b):
            step /= 2
        b += step
        if abs(step).max() < 1e-9:
            break
    b[0] = max(b[0], 0.5)
    return b[0] / s, b[1] - b[0] * m / s


def _unsigned(df: DataFrame):
    """A small frame's rows, its hashes as unsigned numbers."""
    out = df.toPandas()
    for x in {"h", "w"} & {*out.columns}:
        out[x] = out[x].to_numpy(np.int64).view(U64)
    return out


def train(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, held_out: int | None = 5) -> Models:
    """The model from the labelled documents whose bucket modulo `held_out` is not 0."""
    rows = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    if held_out:
        rows = rows.where(bucket_of("doc_id", held_out) != 0)
    turn, rows = F.xxhash64("doc_id"), rows.distinct()
    rows = rows.where("toxic = 0").orderBy(turn, "doc_id").limit(max_docs).unionByName(rows.where("toxic = 1").orderBy(turn, "doc_id").limit(max_docs))
    rows = rows.withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0)
    # at most 2 * max_docs rows of an id and two flags
    both = stored(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id").select("toxic", "fit", "text").dropDuplicates())

    def count(batch):
        """(history, word, class) of each distinct bigram of each text."""
        toxic, texts = np.asarray(batch.column("toxic")), K.strings(batch.column("text"))
        for i, buf, off in K.pieces(texts):
            words = K.Words(buf, off)
            h, w = _pairs(words)
            order = np.lexsort((w, h, words.doc))
            x = np.stack([words.doc.astype(U64), h, w])[:, order]
            x = x[:, np.concatenate([np.ones(min(1, len(h)), bool), (x[:, 1:] != x[:, :-1]).any(0)])]
            yield x[1].view(np.int64), x[2].view(np.int64), toxic[i + x[0].astype(np.int64)]

    of = lambda k: F.count(F.when(F.col("toxic") == k, 1))
    counts = stored(arrow_map(both.where("not fit"), count, "h long, w long, toxic int").groupBy("h", "w").agg(of(0).alias("ordinary"), of(1).alias("toxic")))
    seen = lambda c: F.count(F.when(F.col(c) > 0, 1))
    sums = [F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.count("*").alias("types"), seen("ordinary").alias("after_ordinary"), seen("toxic").alias("after_toxic")]
    enough = F.col("ordinary") + F.col("toxic")
    all_ = counts.agg(*sums, F.count(F.when(enough == 1, 1)).alias("ones"), F.count(F.when(enough == 2, 1)).alias("twos")).first()
    if not all_.ordinary or not all_.toxic:
        return Models()
    words, hist = (_unsigned(counts.groupBy(x).agg(*sums).where(enough >= LEAST)) for x in ("w", "h"))
    pairs = _unsigned(counts.where(enough >= LEAST))
    model = Models.fit(words, hist, pairs, np.array([all_.ordinary, all_.toxic], float), np.array([all_.after_ordinary, all_.after_toxic, all_.types], float), all_.ones / max(all_.ones + 2 * all_.twos, 1))
    held = _apply(both.where("fit"), model, "toxic int").toPandas()
    model.slope, model.intercept = _logistic(held["difference"].to_numpy(), held["toxic"].to_numpy(float))
    return model


def _apply(df: DataFrame, model: Models, keep: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)
    name = keep.split()[0]

    def run(batch):
        texts, at = K.strings(batch.column("text")), batch.column(name)
        for i, buf, off in K.pieces(texts):
            words = K.Words(buf, off)
            yield at.slice(i, len(off) - 1), shared.value.difference(words), shared.value.score(words)

    return arrow_map(df.select(name, "text"), run, f"{keep}, difference double, score double")


def score(documents: DataFrame, model: Models) -> DataFrame:
    """doc_id, difference (of the log-likelihoods per token) and score of each document."""
    return _apply(documents.select(F.col("doc_id").cast("long"), "text"), model, "doc_id long")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that aren't toxic; empty texts and rows without a doc_id are judged like others."""
    shared = spark.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                s = np.concatenate([shared.value.score(K.Words(buf, off)) for _, buf, off in K.pieces(K.strings(batch.column("text")))])
                yield batch.filter(pa.array(s < 0.5))

    return docs.mapInArrow(keep, docs.schema)
