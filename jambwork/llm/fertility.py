"""Quality rules on tokeniser fertility.

Public vocabularies tokenise each distinct word once; a text's measures follow
from its words: characters (punctuation aside) per token of two vocabularies,
the share of tokens that fall back to single bytes, and the entropy of its
tokens relative to the most that so many tokens can have. A text is rejected if
a measure lies outside the band of its language; where the language is not given,
or has fewer than `LEAST` texts, of its script; and if that has too few as well,
of all texts.

A band is the median over all texts of the language (or script) that pass the
base rules, and so many median absolute deviations to both sides, at least a part
of the median. Medians are those of histograms with cells of fixed width, or of
one half percent for deviations, so their size doesn't follow the corpus.

Null and empty texts count as without words: they fail the base rules, and their
measures are null. Repeated rows count like others. Texts are taken whole, the
very long ones one at a time. Rows without a doc_id are judged like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.llm import kernels as K
from jambwork.llm import tokens
from jambwork.llm.common import arrow_map, stored, table

MIN_WORDS, MOST_REPEATED, SPAN = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("piece_chars", "byte_chars", "fallback", "entropy")
U64 = np.uint64
#: Bytes whose distinct words are encoded at once.
AT_ONCE = 4 << 20
#: ASCII punctuation and symbols, which don't count as characters of a token.
PUNCTUATION = np.array([0x20 < x < 0x7F and not chr(x).isalnum() for x in range(256)])
#: First code points of scripts; what lies between belongs to the script before.
SCRIPTS = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other")]


def _twice(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item whether the same hash occurs again in its text, and whether it did before."""
    order = np.lexsort((np.arange(len(h)), h, d))
    same = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
    before, again = np.zeros(len(h), bool), np.zeros(len(h), bool)
    before[order[1:][same]] = True
    again[order[1:][same]] = again[order[:-1][same]] = True
    return again, before


def base(words: K.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n, buf = len(words.first) - 1, words.buf
    ends = np.append(words.base[1:], len(buf))
    per = lambda mask: np.diff(np.append(0, np.cumsum(mask))[np.append(words.base, len(buf))])
    symbol = np.isin(np.arange(256), list(SYMBOLS))
    gap = K.SPACE[buf]
    # lines: a text's last line ends at the space that follows it
    stop = np.flatnonzero((buf == 10) | np.isin(np.arange(len(buf)), ends - 1))
    start = np.append(0, stop[:-1] + 1)
    p, q = K.powers(len(buf) + 1)
    total = np.append(U64(0), np.cumsum((buf.astype(U64) + U64(1)) * p[:-1]))
    line = K.mix((total[stop] - total[start]) * q[start] + (stop - start).astype(U64))
    filled = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    of = np.searchsorted(ends, stop, "right")
    dup = np.bincount(of[filled][_twice(line[filled], of[filled])[1]], minlength=n)
    g = K.ngrams(words.hashes(), SPAN, 3)
    inside = words.doc[: len(g)] == words.doc[SPAN - 1 :] if len(g) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    at = at[_twice(g[at], words.doc[at])[0]]
    cover = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + SPAN, -1)
    return {
        "n_words": np.diff(words.first), "word_chars": per(~gap & ((buf & 0xC0) != 0x80)), "n_symbols": per(symbol[buf]),
        "n_dup_lines": dup, "n_repeat_words": np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n),
    }


class Vocabularies:
    """Ids of distinct words: of a sentence-piece model with byte fallback, and of a byte-level vocabulary."""

    def __init__(self, pieces: str, byte_pairs: str):
        self.model, self.encode = tokens.sentence_pieces(pieces), tokens.byte_pairs(byte_pairs)
        self.is_byte = np.array([self.model.IsByte(i) or self.model.IsUnknown(i) for i in range(self.model.vocab_size())])

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets of each word's ids, number of byte-level ids of each word)."""
        ids, off = tokens.joined(self.model.encode(words, num_threads=1))
        return ids, off, np.array([len(x) for x in self.encode([" " + w for w in words])], np.int64)


def measure(words: K.Words, vocabularies: Vocabularies) -> dict[str, np.ndarray]:
    """MEASURES and script of each text; not a number where it has no words."""
    n, buf = len(words.first) - 1, words.buf
    h = words.hashes()
    _, at, code = np.unique(h, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    distinct = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
    ids, off, count = vocabularies.of(distinct)
    size = np.diff(off)
    d, many = words.doc, size[code]
    lead = np.append(0, np.cumsum(((buf & 0xC0) != 0x80) & ~PUNCTUATION[buf]))
    chars = np.bincount(d, lead[words.end] - lead[words.start], n)
    pieces = np.bincount(d, many, n)
    fall = np.add.reduceat(np.append(vocabularies.is_byte[ids], False).astype(np.int64), off[:-1]) * (size > 0) if len(distinct) else np.zeros(0)
    i = np.repeat(off[:-1][code] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
    pair = np.sort((np.repeat(d, many).astype(U64) << U64(32)) | ids[i].astype(U64)) if len(i) else np.zeros(0, U64)
    new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(pair)))
    own = (pair[new] >> U64(32)).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2(pieces) - np.bincount(own, times * np.log2(times), n) / pieces
        out = {"piece_chars": chars / pieces, "byte_chars": chars / np.bincount(d, count[code], n), "fallback": np.bincount(d, fall[code], n) / pieces, "entropy": bits / np.maximum(np.log2(np.minimum(pieces, len(vocabularies.is_byte))), 1)}
    kind = np.array([max(map(ord, w)) if w else 0 for w in distinct], np.int64)
    script = np.searchsorted([x[0] for x in SCRIPTS], kind, "right") - 1
    names = sorted({x[1] for x in SCRIPTS})
    of = np.array([names.index(x[1]) for x in SCRIPTS])[script] if len(distinct) else np.zeros(0, np.int64)
    votes = np.bincount(d * len(names) + of[code], minlength=n * len(names)).reshape(n, len(names)) if len(d) else np.zeros((n, len(names)))
    return out | {"script": np.where(pieces > 0, np.array(names, object)[votes.argmax(1)], "none")}


def measured(docs: DataFrame, pieces: str, byte_pairs: str) -> DataFrame:
    """The base counts and the measures of each row of docs (doc_id, lang, text)."""
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batch):
        v = Vocabularies(pieces, byte_pairs)
        ids, lang = batch.column("doc_id"), batch.column("lang")
        for i, buf, off in K.pieces(K.strings(batch.column("text")), AT_ONCE):
            words = K.Words(buf, off, lower=False)
            b, m = base(words), measure(words, v)
            yield ids.slice(i, len(off) - 1), lang.slice(i, len(off) - 1), *(pa.array(b[x].astype(np.int64)) for x in longs), *(pa.array(m[x], from_pandas=True) for x in MEASURES), pa.array(m["script"], pa.string())

    schema = "doc_id long, lang string, " + ", ".join(f"{x} long" for x in longs) + ", " + ", ".join(f"{x} double" for x in MEASURES) + ", script string"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), run, schema)


#: Deviations that a band reaches to both sides; texts that a language's own band needs.
REACH, LEAST = 5.0, 10
#: A deviation is at least so much of the median, or of 1 for shares.
FLOORS = {"piece_chars": 0.01, "byte_chars": 0.01, "fallback": 0.02, "entropy": 0.08}


#: What a text's bands can belong to, the first with enough texts counts.
SCOPES = ("lang", "script", "every")


def _medians(rows: DataFrame, cell, value) -> DataFrame:
    """scope, key, measure, the median of value (of a cell) and the number of texts."""
    counts = rows.groupBy("scope", "key", "measure", cell.alias("cell")).count().withColumn("v", value(F.col("cell")))
    return counts.groupBy("scope", "key", "measure").agg(F.expr("percentile(v, 0.5, count)").alias("median"), F.sum("count").alias("texts"))


def bands(stats: DataFrame) -> DataFrame:
    """scope and key, number of texts, median and spread (a text's deviation times the root of its words) of each measure."""
    measures = F.explode(F.map_from_arrays(F.array(*map(F.lit, MEASURES)), F.array(*MEASURES))).alias("measure", "x")
    long = stats.where("not base_failed").select(*SCOPES, "n_words", measures).where("x is not null")
    long = long.select("measure", "x", "n_words", F.explode(F.map_from_arrays(F.array(*map(F.lit, SCOPES)), F.array(*SCOPES))).alias("scope", "key")).where("key is not null")
    middle = stored(_medians(long, F.round("x", 4), lambda c: c))
    away = F.abs(F.col("x") - F.col("median")) * F.sqrt("n_words")
    spread = _medians(long.join(middle.drop("texts"), ["scope", "key", "measure"]), F.when(away > 1e-6, F.floor(F.log(away) * 200)), lambda c: F.coalesce(F.exp((c + 0.5) / 200), F.lit(0.0)))
    band = middle.join(spread.select("scope", "key", "measure", (F.col("median") * 1.4826).alias("spread")), ["scope", "key", "measure"])
    return band.groupBy("scope", "key").agg(F.max("texts").alias("texts"), F.map_from_entries(F.collect_list(F.struct("measure", F.struct("median", "spread")))).alias("band"))


def judged(docs: DataFrame, pieces: str, byte_pairs: str) -> DataFrame:
    """Base counts, measures, base_failed and kept of each row of docs (doc_id, lang, text)."""
    stats = measured(docs, pieces, byte_pairs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = stored(stats.withColumn("base_failed", failed).withColumn("lang", F.nullif("lang", F.lit(""))).withColumn("every", F.lit("all")))
    found, rows = stored(bands(stats)), stats
    for scope in SCOPES:
        own = found.where(F.col("scope") == scope).where(F.col("texts") >= (1 if scope == "every" else LEAST))
        rows = rows.join(own.select(F.col("key").alias(scope), F.col("band").alias(f"band_{scope}")), scope, "left")
    rows = rows.withColumn("band", F.coalesce(*(f"band_{x}" for x in SCOPES)))
    inside = F.lit(True)
    for x, floor in FLOORS.items():
        median, spread = F.col("band")[x]["median"], F.col("band")[x]["spread"]
        away = F.greatest(spread / F.sqrt("n_words"), F.lit(floor) if x == "fallback" else floor * median)
        inside &= F.coalesce(F.abs(F.col(x) - median) <= REACH * away, F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside).drop("band", "lang", "every", *(f"band_{x}" for x in SCOPES))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), tokens.public("piece_bpe_32k.model"), tokens.public("byte_bpe_50k.json"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)
