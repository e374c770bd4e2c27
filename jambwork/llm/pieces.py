"""SentencePiece encoding and decoding of merge-type vocabularies.

A text's symbols begin as its characters. An agenda holds each adjacent pair that
together spells a piece; the entry of the highest score, the leftmost among equals,
is merged first, and the new symbol's pairs join the agenda, until it is empty.
Symbols that are no piece become bytes.

No merge crosses two characters that no piece has side by side, so texts are cut
there first. Distinct segments are encoded once for each worker's bounded cache:
short ones of a batch have their agendas side by side in arrays, one row each, of
which every round takes the best entry; longer ones have a heap. The sentencepiece
library encodes the same segments of the batch, and decodes all ids of each row;
`agrees` says whether it comes to the same in both.

Null texts are empty: the begin and end ids alone. Each row gives a row: repeated
rows and ids, and rows without an id, are texts of their own. A text of any length
is handled in slices of bounded size, but for its ids, which one row holds. Other
columns of the table are not read.
"""

from __future__ import annotations

import codecs
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.llm import kernels as K
from jambwork.llm import tokens
from jambwork.llm.common import arrow_map, table

#: What a space is in pieces; here it is a space everywhere.
MARK = "▁"
#: Segments of up to so many characters share arrays and are cached; segments that the cache holds; characters at once.
SHORT, CACHED, AT_ONCE = 64, 300_000, 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Pieces:
    """A vocabulary's pieces, what pairs of symbols merge to, and the ids of segments."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or USER in kinds or UNUSED in kinds:
            raise ValueError(f"{path} is no merge-type vocabulary of plain pieces with byte fallback")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} changes texts before it encodes them")
        self.library = tokens.sentence_pieces(path)
        self.prefix = " " if spec.add_dummy_prefix else ""
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        names = [p.piece.replace(MARK, " ") for p in model.pieces]
        normal = {x: i for i, (x, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
        self._surfaces(names, kinds, model.trainer_spec.unk_surface)
        self._symbols(normal)
        self._merges(normal, {i: model.pieces[i].score for i in normal.values()})
        self._forget()

    def _surfaces(self, names: list[str], kinds: list[int], unknown: str) -> None:
        """What each id is decoded to."""
        self.length = [len(x) for x in names]
        self.bytes = {int(x[1:-1], 16): i for i, (x, k) in enumerate(zip(names, kinds, strict=True)) if k == BYTE}
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.spaced = {i for i, (x, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL and x[0] == " "}
        say = {CONTROL: lambda x: b"", BYTE: lambda x: bytes([int(x[1:-1], 16)]), UNKNOWN: lambda x: unknown.encode(), NORMAL: str.encode}
        self.surface = [say[k](x) for x, k in zip(names, kinds, strict=True)]

    def _symbols(self, normal: dict[str, int]) -> None:
        """Ids of characters: of those that are no piece of their own, ids after all pieces; and where texts can be cut."""
        self.symbol = {c: i for c, i in normal.items() if len(c) == 1}
        for c in sorted({c for x in normal for c in x} - self.symbol.keys()):
            self.symbol[c] = len(self.surface) + len(self.symbol)
        self.other = max([len(self.surface), *(i + 1 for i in self.symbol.values())])
        self.of_code = np.full(0x110000, self.other, np.int64)
        self.of_code[[ord(c) for c in self.symbol]] = [*self.symbol.values()]
        self.beside = {x[i : i + 2] for x in normal for i in range(len(x) - 1)}
        #: A character that is in no piece. The library sets spaces before texts; after this one, a text is as within another.
        self.guard = next(c for c in map(chr, chain([10], range(0x110000))) if c not in self.symbol)
        #: By the last byte of a character and the first of the next: whether no piece has the two.
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = [[chr(a) + chr(b) not in self.beside for b in range(128)] for a in range(128)]
        self.apart[128:, 32] = not any(x[1] == " " != x[0] for x in self.beside)

    def _merges(self, normal: dict[str, int], score: dict[int, float]) -> None:
        """keys (left * wide + right, sorted) with the piece that the pair makes and its rank, low for high scores."""
        of = self.symbol | normal
        level = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.wide, self.never = self.other + 1, len(level)
        found = {of[x[:k]] * self.wide + of[x[k:]]: i for x, i in normal.items() for k in range(1, len(x)) if x[:k] in of and x[k:] in of}
        self.pair = {k: (level[score[found[k]]], found[k]) for k in sorted(found)}
        self.keys = np.array([*self.pair, 1 << 62], np.int64)
        self.rank, self.made = np.array([*self.pair.values(), (self.never, 0)], np.int32).T.copy()

    def _forget(self) -> None:
        """Empties the cache: the place of each segment, and ids by place."""
        self.place: dict[str, int] = {}
        self.ids, self.off, self.wrong = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair; rank `never` where it makes no piece."""
        key = left * self.wide + right
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = -1
        return self.rank[at], self.made[at]

    def symbols(self, text: str) -> np.ndarray:
        return self.of_code[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def spelled(self, ids: list[int], text: str) -> list[int]:
        """The symbols of a text with bytes for those that are no pieces, each one character."""
        out, at = [], 0
        for i in ids:
            if i < len(self.surface):
                out.append(i)
                at += self.length[i]
            else:
                out += [self.bytes[b] for b in text[at].encode()]
                at += 1
        return out

    def heap(self, text: str) -> bytes:
        """The ids of one text by an agenda in a heap, with links between the symbols that are left."""
        ids = array("q", self.symbols(text).tobytes())
        n, wide, pair = len(ids), self.wide, self.pair
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        agenda = [pair[k][0] * n + i for i in range(n - 1) if (k := ids[i] * wide + ids[i + 1]) in pair]
        heapq.heapify(agenda)
        while agenda:
            rank, i = divmod(heapq.heappop(agenda), n)
            if ids[i] < 0 or (j := after[i]) == n or (now := pair.get(ids[i] * wide + ids[j])) is None or now[0] != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = now[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := pair.get(ids[i] * wide + ids[k])) is not None:
                    heapq.heappush(agenda, new[0] * n + i)
            if (h := before[i]) >= 0 and (new := pair.get(ids[h] * wide + ids[i])) is not None:
                heapq.heappush(agenda, new[0] * n + h)
        return _packed(self.spelled([x for x in ids if x >= 0], text))

    def rows(self, texts: list[str]) -> list[bytes]:
        """The ids of short texts: each round merges every row's best pair."""
        long = np.array([len(x) for x in texts])
        n, size = len(texts), int(long.max())
        cols = np.arange(size + 1)
        ids = np.full((n, size + 1), -1, np.int64)
        ids[cols < long[:, None]] = self.symbols("".join(texts))
        final, left = ids.copy(), np.arange(n)
        rank, _ = self.look(ids[:, :-1], ids[:, 1:])
        while len(left):
            best = rank.argmin(1)
            go = rank[np.arange(len(left)), best] < self.never
            if not go.all():
                final[left[~go], : ids.shape[1]] = ids[~go]
                final[left[~go], ids.shape[1] :] = -1
                left, best, ids, rank = left[go], best[go], ids[go], rank[go]
            row, width = np.arange(len(left)), ids.shape[1]
            new = self.look(ids[row, best], ids[row, best + 1])[1]
            move = cols[: width - 1] > best[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=move)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=move[:, :-1])
            ids[row, best] = new
            for at in (best - 1, best):  # the new symbol's two pairs
                r, c = row[at >= 0], at[at >= 0]
                rank[r, c], _ = self.look(ids[r, c], ids[r, c + 1])
            used = int((ids >= 0).sum(1).max(initial=0)) + 1
            ids, rank = ids[:, :used], rank[:, : used - 1]
        data, ends = final[final >= 0].astype("<u4").tobytes(), [*accumulate((4 * (final >= 0).sum(1)).tolist())]
        out = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.flatnonzero((final >= len(self.surface)).any(1)).tolist():
            out[k] = _packed(self.spelled(final[k][final[k] >= 0].tolist(), texts[k]))
        return out

    def parts(self, segment: str) -> Iterator[str]:
        """Cuts a segment between characters that no piece has side by side."""
        at = 0
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in self.beside:
                yield segment[at:i]
                at = i
        yield segment[at:]

    def agendas(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment."""
        cut = {x: [*self.parts(x)] for x in segments if len(x) > SHORT}
        done: dict[str, bytes] = {}
        sizes: dict[int, list[str]] = {}
        for x in {*segments, *chain.from_iterable(cut.values())} if cut else segments:
            if len(x) <= SHORT:
                sizes.setdefault(len(x) + 3 >> 2, []).append(x)
            elif x not in cut or cut[x] == [x]:
                done[x] = self.heap(x)
        for xs in sizes.values():
            done.update(zip(xs, self.rows(xs), strict=True))
        return [b"".join([done[p] for p in cut[x]]) if x in cut else done[x] for x in segments]

    def learn(self, segments: list[str]) -> None:
        """Adds segments and their ids, and whether the library comes to others."""
        own = self.agendas(segments)
        drop = len(self.library.encode(self.guard))
        theirs = self.library.encode([self.guard + x for x in segments], num_threads=1)
        data, ends = _packed([*chain.from_iterable(theirs)]), [*accumulate(map(len, theirs))]
        wrong = [ids != data[4 * (a + drop) : 4 * b] for ids, a, b in zip(own, [0, *ends], ends, strict=False)]
        self.place.update(zip(segments, range(len(self.wrong), len(self.wrong) + len(own)), strict=True))
        self.wrong = np.append(self.wrong, wrong)
        self.ids = np.append(self.ids, np.frombuffer(b"".join(own), "<u4"))
        self.off = np.append(self.off, self.off[-1] + np.cumsum([len(x) // 4 for x in own]))

    def places(self, segments: list[str]) -> np.ndarray:
        """Where the ids of distinct segments are."""
        new = [x for x in segments if x not in self.place]
        if len(self.place) + len(new) > CACHED:
            self._forget()
            new = segments
        if new:
            self.learn(new)
        out = np.array([self.place[x] for x in segments], np.int64)
        for x in new:
            if len(x) > SHORT:  # its ids stay until the cache is emptied, but it is not found again
                del self.place[x]
        return out

    def encode_parts(self, parts: list[str]) -> list[tuple[bytes, bool]]:
        """(ids, whether the library agrees) of parts of texts."""
        buf, off = K.flat(pa.array(parts, pa.large_string()))
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = self.apart[buf[:-1], buf[1:]]
        cut[off] = True
        start = np.flatnonzero(cut)
        found = pa.LargeStringArray.from_buffers(len(start) - 1, pa.py_buffer(start.astype(np.int64)), pa.py_buffer(buf)).dictionary_encode()
        at = self.places(found.dictionary.to_pylist())[found.indices.to_numpy()]
        size = self.off[at + 1] - self.off[at]
        ends = np.append(0, np.cumsum(size))
        data = self.ids[np.repeat(self.off[at] - ends[:-1], size) + np.arange(ends[-1])].astype("<u4").tobytes()
        first = np.searchsorted(start, off)
        bad = np.append(0, np.cumsum(self.wrong[at]))[first]
        bounds = (4 * ends[first]).tolist()
        if len(self.ids) > 16 * CACHED:  # of segments too long to be found again
            self._forget()
        return [(data[a:b], not wrong) for a, b, wrong in zip(bounds, bounds[1:], np.diff(bad).tolist(), strict=False)]

    def slices(self, text: str) -> Iterator[str]:
        """A text as pieces see it, in slices cut before spaces."""
        text = self.prefix + text.replace(MARK, " ") if text else ""
        at = 0
        while at < len(text):
            to = at + AT_ONCE
            while 0 < to < len(text) and not (text[to] == " " != text[to - 1]):
                to = text.find(" ", to + 1)
            to = to if 0 < to < len(text) and self.apart[128, 32] else len(text)
            yield text[at:to]
            at = to

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Each text's ids, begin and end included, as unsigned 32-bit integers, and whether the library agrees."""
        out = [([_packed([self.begin])], []) for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self.slices(text):
                held.append((k, part))
                size += len(part)
                if size >= AT_ONCE:
                    self._flush(held, out)
                    size = 0
        self._flush(held, out)
        return [(b"".join([*ids, _packed([self.end])]), all(agrees)) for ids, agrees in out]

    def _flush(self, held: list[tuple[int, str]], out: list[tuple[list[bytes], list[bool]]]) -> None:
        for (k, _), (ids, agrees) in zip(held, self.encode_parts([x for _, x in held]) if held else [], strict=True):
            out[k][0].append(ids)
            out[k][1].append(agrees)
        held.clear()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        inner = ids[ids[:1] == [self.begin] : len(ids) - (ids[-1:] == [self.end])]
        runs = [[*x] for plain, x in groupby(inner, lambda i: i not in self.control) if plain] if not self.control.isdisjoint(inner) else [inner]
        text = "".join([b"".join([self.surface[i] for i in x]).decode("utf-8", "each_byte") for x in runs])
        return text[1:] if self.prefix and runs and runs[0] and runs[0][0] in self.spaced else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit, begin and end included) and agrees (with the library) of each row."""

    def run(batch):
        texts = K.strings(batch.column("text"))
        for at, _, off in K.pieces(texts, AT_ONCE):
            got = pieces(vocabulary).encode(texts.slice(at, len(off) - 1).to_pylist())
            yield batch.column("doc_id").slice(at, len(got)), pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, agrees boolean")


def decoded(rows: DataFrame, vocabulary: str) -> DataFrame:
    """rows of `encoded` with the text that their ids decode to; agrees is false too where the library decodes them to another."""

    def run(batch):
        own, texts, agrees, size = pieces(vocabulary), [], [], 0
        for i, (data, same) in enumerate(zip(batch.column("ids"), batch.column("agrees"), strict=True), 1):
            ids = np.frombuffer(data.as_py(), "<u4").tolist()
            texts.append(own.decode(ids))
            agrees.append(same.as_py() and texts[-1] == own.library.decode(ids))
            size += len(texts[-1])
            if size > AT_ONCE or i == batch.num_rows:
                n = len(texts)
                yield *(batch.column(c).slice(i - n, n) for c in ("doc_id", "ids")), pa.array(agrees), pa.array(texts)
                texts, agrees, size = [], [], 0

    return arrow_map(rows.select("doc_id", "ids", "agrees"), run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, agrees boolean, text string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each document; agrees: the library comes to the same ids and text."""
    path = tokens.public("piece_bpe_32k.model")
    rows = decoded(encoded(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"), "agrees")
