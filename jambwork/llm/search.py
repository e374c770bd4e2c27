"""Ranked lexical search: the k best documents of each item.

A threshold-seeded join. Items come in blocks of bounded size. For a block, each
document's counts of the block's terms are stored once; from them come the
documents that hold each term, and each term's largest and k-th largest impact
(what a document's count of a term is worth, before the term's weight).

As k documents reach a term's k-th impact, an item's k-th best score is at least
the largest of its terms' weighted k-th impacts: the seed of its threshold, which
the k-th best exact score that a task has found raises. An item's terms are in
order of their largest weighted impacts. Where the sum of these over all terms
from some place on is below the threshold, documents that hold those terms only
can't be among the best. So candidates come from the lists of the terms before
that place; those whose sum so far and the bound of the rest reach the threshold
are scored exactly from all their counts. A task emits k rows of each item at
most, and a window takes the best k of all.

Null and empty texts have no terms: such documents are not counted and no result,
such items have none. Rows that share an id, or have none, are documents or items
of their own; null ids come last among equal scores. A text of any length is
handled whole, by the task that has its row. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jambwork.llm import kernels as K
from jambwork.llm.common import arrow_map, scratch, stored, table

#: Term rows of items in one block (an item alone may have more); documents that are scored at once; bytes of text at once.
TERMS_AT_ONCE, DOCS_AT_ONCE, BYTES_AT_ONCE = 200_000, 4096, 1 << 22

#: Bytes of terms: letters, digits and everything beyond ASCII.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _terms(column: pa.Array):
    """(first row, Words, dictionary of terms, place of each word's term in it) of consecutive texts."""
    for at, buf, off in K.pieces(K.strings(column), BYTES_AT_ONCE):
        words = K.Words(buf, off, gaps=_OUTSIDE.__getitem__)
        found = words.strings().dictionary_encode()
        yield at, words, found.dictionary, found.indices.to_numpy()


def _counted(doc: np.ndarray, term: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, times) of distinct pairs, in order."""
    key, times = np.unique(doc.astype(np.int64) * wide + term, return_counts=True)
    return key // wide, key % wide, times


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of each row), item_id, term and times of each item's distinct terms."""

    def run(batch):
        for at, words, names, term in _terms(batch.column("text")):
            doc, t, times = _counted(words.doc, term, max(1, len(names)))
            rows = pa.array(doc + at)
            yield batch.column("item").take(rows), batch.column("item_id").take(rows), names.take(pa.array(t)).cast(pa.string()), times

    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return arrow_map(rows, run, f"item long, item_id {items.schema['item_id'].dataType.simpleString()}, term string, times long")


class Block:
    """The items of a block: names of all terms in order, and each item's terms and how often it has them."""

    def __init__(self, rows: pa.Table):
        names = sorted(set(rows.column("term").to_pylist()))
        self.place = {x: i for i, x in enumerate(names)}
        term = np.array([self.place[x] for x in rows.column("term").to_pylist()], np.int64)
        item, times = rows.column("item").to_numpy(), rows.column("times").to_numpy()
        self.items, start = np.unique(item, return_index=True) if len(item) else (item, item)
        order = np.argsort(item, kind="stable")
        bounds = np.append(np.searchsorted(item[order], self.items), len(item))
        self.of = [(term[order[a:b]], times[order[a:b]]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def postings(docs: DataFrame, place) -> DataFrame:
    """doc_id, n (terms with repeats), terms and times (unsigned 32-bit) of each document with a term; place: a broadcast of the terms asked for."""

    def run(batch):
        known = place.value
        for at, words, names, term in _terms(batch.column("text")):
            n = np.diff(words.first)
            code = np.array([known.get(x, -1) for x in names.to_pylist()], np.int64)[term] if len(term) else np.zeros(0, np.int64)
            doc, t, times = _counted(words.doc[code >= 0], code[code >= 0], max(1, len(known)))
            rows = np.flatnonzero(n)
            off = np.append(np.searchsorted(doc, rows), len(doc)).astype(np.int32) * 4
            pack = lambda x, off=off: pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(x.astype("<u4"))])
            yield batch.column("doc_id").take(pa.array(rows + at)), n[rows].astype(np.int64), pack(t), pack(times)

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms binary, times binary")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, times, n of each doc) of rows of postings."""
    flat = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").astype(np.int64)
    size = np.array([len(x) // 4 for x in batch.column("terms").to_pylist()], np.int64)
    return np.repeat(np.arange(batch.num_rows), size), flat("terms"), flat("times"), batch.column("n").to_numpy()


def _impacts(doc: np.ndarray, times: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    m = 100 - 25 + (25 * n * docs) // total
    return (1_000_000_000 * times) // (1000 * times + 12 * m[doc])


def _frequencies(rows: DataFrame, wide: int) -> DataFrame:
    """term and df from postings, summed by each task first."""

    def run(batches):
        df = np.zeros(wide, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=wide)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    return rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _largest(term: np.ndarray, impact: np.ndarray, k: int) -> np.ndarray:
    """Where each term's k largest impacts are."""
    order = np.lexsort((-impact, term))
    t = term[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    return order[np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t)))) < k]


def kth_impacts(rows: DataFrame, docs: int, total: int, k: int) -> DataFrame:
    """term, most (its largest impact) and kth (its k-th largest; 0 where fewer documents hold it)."""

    def run(batches):
        term = impact = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                doc, t, times, n = _lists(batch.slice(at, DOCS_AT_ONCE))
                term, impact = np.append(term, t), np.append(impact, _impacts(doc, times, n, docs, total))
                best = _largest(term, impact, k)
                term, impact = term[best], impact[best]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(impact)], names=["term", "impact"])

    best = rows.select("n", "terms", "times").mapInArrow(run, "term long, impact long")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("place") <= k)
    return best.groupBy("term").agg(F.max("impact").alias("most"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth"))


class Scorer:
    """Candidates and exact scores of a block's items, for rows of postings one after another."""

    def __init__(self, plan: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], k: int, wide: int):
        """plan: each item's terms by falling bound, their weights (times included), the bound of each suffix (one more entry), and its seed."""
        self.plan, self.k = plan, k
        self.floor = [x[3] for x in plan]
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in plan]
        self.ids: list = []
        self.weight = np.zeros(wide, np.int64)

    def add(self, batch: pa.RecordBatch, docs: int, total: int) -> None:
        doc, term, times, n = _lists(batch)
        impact = _impacts(doc, times, n, docs, total)
        begin = np.append(np.searchsorted(doc, np.arange(batch.num_rows)), len(doc))
        order = np.argsort(term, kind="stable")
        by, held, worth = term[order], doc[order], impact[order]
        ids = batch.column("doc_id").to_pylist()
        base = len(self.ids)
        self.ids += ids
        for i, (terms, weights, rest, _) in enumerate(self.plan):
            asked = len(rest) - np.searchsorted(rest[::-1], self.floor[i], "left") if self.floor[i] else len(terms)
            asked = min(int(asked), len(terms))
            a, b = np.searchsorted(by, terms[:asked]), np.searchsorted(by, terms[:asked], "right")
            size = b - a
            if not size.sum():
                continue
            at = np.repeat(a - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            score = np.zeros(batch.num_rows, np.int64)
            np.add.at(score, held[at], worth[at] * np.repeat(weights[:asked], size))
            found = np.flatnonzero((score > 0) & (score + rest[asked] >= self.floor[i]))
            if asked < len(terms) and len(found):
                self.weight[terms] = weights
                size = begin[found + 1] - begin[found]
                at = np.repeat(begin[found] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                exact = np.zeros(len(found), np.int64)
                np.add.at(exact, np.repeat(np.arange(len(found)), size), self.weight[term[at]] * impact[at])
                self.weight[terms] = 0
            else:
                exact = score[found]
            keep = exact >= self.floor[i]
            if keep.any():
                self._take(i, exact[keep], base + found[keep])
        self._tidy()

    def _take(self, i: int, score: np.ndarray, row: np.ndarray) -> None:
        score, row = np.append(self.best[i][0], score), np.append(self.best[i][1], row)
        if len(score) > self.k:
            ids = [self.ids[r] for r in row.tolist()]
            order = sorted(range(len(ids)), key=lambda j: (-score[j], ids[j] is None, ids[j] or 0)) if len(ids) < 4 * self.k else self._order(score, ids)
            score, row = score[order[: self.k]], row[order[: self.k]]
            self.floor[i] = max(self.floor[i], int(score.min()))
        self.best[i] = score, row

    def _order(self, score: np.ndarray, ids: list) -> list[int]:
        """As sorted would give, among the k best scores and what ties with the last of them."""
        least = np.partition(score, len(score) - self.k)[len(score) - self.k]
        return sorted(np.flatnonzero(score >= least).tolist(), key=lambda j: (-score[j], ids[j] is None, ids[j] or 0))

    def _tidy(self) -> None:
        """Forgets the ids of documents that are among no item's best."""
        rows = np.unique(np.concatenate([x[1] for x in self.best]) if self.best else np.zeros(0, np.int64))
        self.ids = [self.ids[r] for r in rows.tolist()]
        self.best = [(s, np.searchsorted(rows, r)) for s, r in self.best]


def _plan(block: Block, weight: np.ndarray, most: np.ndarray, kth: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    out = []
    for terms, times in block.of:
        w = weight[terms] * times
        order = np.argsort(-w * most[terms], kind="stable")
        terms, w = terms[order], w[order]
        rest = np.append(np.cumsum((w * most[terms])[::-1])[::-1], 0)
        out.append((terms, w, rest, int((w * kth[terms]).max(initial=0))))
    return out


def _block_best(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """item, doc_id and score: the best rows that each task finds for the items of a block."""
    spark = docs.sparkSession
    block = Block(rows.select("item", "term", "times").toArrow())
    wide = len(block.place)
    place = spark.sparkContext.broadcast(block.place)
    held = stored(postings(docs, place))
    docs_n, total = held.agg(F.count("*"), F.sum("n")).first()
    column = lambda df, *names: [np.bincount(x.column("term").to_numpy(), x.column(c).to_numpy(), wide).astype(np.int64) for x in [df.toArrow()] for c in names]
    (df,) = column(_frequencies(held, wide), "df")
    most, kth = column(stored(kth_impacts(held, docs_n, total or 1, k)), "most", "kth")
    weight = np.array([math.floor(1000 * math.log((2 * docs_n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    plan = spark.sparkContext.broadcast(_plan(block, weight, most, kth))
    items, kind = block.items, docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scorer, schema = Scorer(plan.value, k, wide), None
        for batch in batches:
            schema = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                scorer.add(batch.slice(at, DOCS_AT_ONCE), docs_n, total)
        if schema is not None:
            for i, (score, row) in enumerate(scorer.best):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), items[i])), pa.array([scorer.ids[r] for r in row.tolist()], schema), pa.array(score)], names=["item", "doc_id", "score"])

    return held.mapInArrow(run, f"item long, doc_id {kind}, score long")


def top(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item. docs: doc_id, text; items: item_id, text."""
    with scratch(docs.sparkSession):
        rows = stored(item_terms(items))
        blocks = -(-rows.count() // TERMS_AT_ONCE)
        best = None
        for b in range(blocks):
            part = _block_best(docs, rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k)
            part = stored(part)
            best = part if best is None else best.unionByName(part)
        if best is None:
            return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
        order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id")]
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = rows.select("item", "item_id").distinct()
        return stored(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), keep=True)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
p AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(t) * docs) // total)) AS impact FROM f JOIN d USING (r), s),
x AS (SELECT i, item_id, doc_id, r, sum(times * w * impact)::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM y WHERE rank <= 20
"""
