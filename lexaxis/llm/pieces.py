"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one per character, with U+2581 for a space and one more
in front. All adjacent pairs that are in the vocabulary stand on an agenda; the
pair of best score, and of those the leftmost, is merged, and the pairs that
this makes join the agenda, until it is empty. Symbols that are not in the
vocabulary become their UTF-8 bytes' pieces.

No piece of such a vocabulary has U+2581 after another character, so no merge
crosses the border before a run of them: a text's segments are encoded each by
itself, and equal segments once. Every segment that a worker meets for the
first time is encoded by the sentencepiece library too, batch by batch, and has
to come out the same.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lexaxis.llm.common import id_and_text, numbered

SPACE = "▁"
#: Segments that a worker remembers; beyond it, it starts afresh. Bounds memory, not the result.
REMEMBERED = 700_000

#: Longest segment, in characters, that is merged in step with others.
LOCKSTEP = 48
NEVER = np.iinfo(np.int32).max

_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Vocabulary:
    """Pieces, scores and byte pieces of a .model file, with the library's own encoder beside them."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.bytes.items()}
        self.skip = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {self.text[i]: i for i in usable}
        order = sorted(usable, key=lambda i: -sp.get_score(i))
        rank, last, ranks = 0, None, {}
        for i in order:  # pieces of equal score have equal rank: the leftmost goes first
            if sp.get_score(i) != last:
                rank, last = rank + 1, sp.get_score(i)
            ranks[self.text[i]] = rank
        self.rank = ranks
        if len(self.bytes) != 256 or any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids):
            raise ValueError("a merge-type vocabulary with byte fallback, whose pieces have spaces only in front, is needed")
        if sp.normalize("ﬁ   a") != f"{SPACE}ﬁ{SPACE} {SPACE}a":
            raise ValueError("a vocabulary without normalisation, with a space put in front, is needed")
        self.known: dict[str, bytes] = {}
        # for decoding: what stands for itself, and which ids need more care
        self.plain = [t.replace(SPACE, " ") for t in self.text]
        self.rare = np.ones(n, bool)
        self.rare[usable] = False
        for b in range(128):
            self.plain[self.bytes[b]], self.rare[self.bytes[b]] = chr(b), False
        spelled = [t.encode() for t in self.plain]
        spelled += [t[1:] if t[:1] == b" " and i not in self.value else t for i, t in enumerate(spelled)]  # at the head of a text
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array(list(map(len, spelled)), np.int64)
        self.start = np.cumsum(self.length) - self.length
        # for merging in step: symbols are ids, or n + code point for characters without a piece
        self.of_char = np.arange(0x110000, dtype=np.int64) + n
        for b in range(128):
            self.of_char[b] = self.bytes[b]
        for t, i in self.ids.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        own = lambda t: int(self.of_char[ord(t)]) if len(t) == 1 else self.ids.get(t)
        pairs = [(a << 22 | b, ranks[t], i) for t, i in self.ids.items() for c in range(1, len(t)) if (a := own(t[:c])) is not None and (b := own(t[c:])) is not None]
        self.pair, self.pair_rank, self.pair_id = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
        chars = "\x01-\x7f" + "".join(re.escape(t) for t in self.ids if len(t) == 1)
        self.simple = re.compile(f"[{chars}]*").fullmatch

    def merge(self, segment: str) -> list[int]:
        """The pieces of one segment by the agenda."""
        symbol = list(segment)
        n = len(symbol)
        rank = self.rank.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            r = rank(symbol[i] + symbol[i + 1])
            if r is not None:
                agenda.append((r, i, symbol[i], symbol[i + 1]))
        heapify(agenda)
        while agenda:
            _, i, a, b = heappop(agenda)
            if symbol[i] != a:
                continue
            j = after[i]
            if j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = a + b, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(symbol[i] + symbol[k])
                if r is not None:
                    heappush(agenda, (r, i, symbol[i], symbol[k]))
            h = before[i]
            if h >= 0:
                r = rank(symbol[h] + symbol[i])
                if r is not None:
                    heappush(agenda, (r, h, symbol[h], symbol[i]))
        out: list[int] = []
        for s in symbol:
            if s:
                piece = self.ids.get(s)
                if piece is not None:
                    out.append(piece)
                else:
                    out.extend(self.bytes[b] for b in s.encode())
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of the pieces that pairs of symbols make; rank NEVER where they make none."""
        key = left.astype(np.int64) << 22 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        ok = self.pair[at] == key
        return np.where(ok, self.pair_rank[at], NEVER), self.pair_id[at]

    def merge_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, number of each): the agenda of merge(), a row to a segment, all rows in step.

        The segments have at most LOCKSTEP characters, all in the vocabulary.
        """
        n = len(segments)
        width = max(map(len, segments))
        code = np.array(segments, dtype=f"<U{width}").view(np.uint32).reshape(n, width)
        size = (code != 0).sum(1)
        symbol = self.of_char[code]
        place = np.arange(width)
        alive = place < size[:, None]
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        rank = np.full((n, width), NEVER, np.int32)
        piece = np.zeros((n, width), np.int32)
        row, at = np.nonzero(alive[:, 1:])
        rank[row, at], piece[row, at] = self._lookup(symbol[row, at], symbol[row, at + 1])
        active = np.arange(n)
        while len(active):
            best = rank[active].argmin(1)  # of equal ranks the leftmost
            go = rank[active, best] != NEVER
            active, i = active[go], best[go]
            gone = after[active, i]
            symbol[active, i] = piece[active, i]
            alive[active, gone] = False
            rank[active, gone] = NEVER
            following = after[active, gone]
            after[active, i] = following
            has = following < size[active]
            r, f, j = active[has], following[has], i[has]
            before[r, f] = j
            rank[active, i] = NEVER
            rank[r, j], piece[r, j] = self._lookup(symbol[r, j], symbol[r, f])
            has = i > 0
            r, j = active[has], i[has]
            h = before[r, j]
            rank[r, h], piece[r, h] = self._lookup(symbol[r, h], symbol[r, j])
        return symbol[alive], alive.sum(1)

    def learn(self, words: list[str]) -> None:
        """Encodes segments, given without the U+2581 they begin with, and checks them against the library in one call."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        theirs = self.library.encode([w.replace(SPACE, " ") for w in words], num_threads=1)  # which puts a space in front
        simple = self.simple
        regular, odd = [], []
        for k, w in enumerate(words):
            (regular if 0 < len(w) < LOCKSTEP and simple(w) else odd).append(k)
        for k in odd:
            mine = self.merge(SPACE + words[k])
            if words[k] and mine != theirs[k]:  # the library makes nothing of no text
                raise ValueError(f"{words[k]!r} is {mine} by the agenda, {theirs[k]} by the library")
            self.known[words[k]] = np.array(mine, np.int32).tobytes()
        regular.sort(key=lambda k: len(words[k]))
        for at in range(0, len(regular), 4096):
            part = regular[at : at + 4096]
            flat, counts = self.merge_all([SPACE + words[k] for k in part])
            want = [theirs[k] for k in part]
            if counts.tolist() != list(map(len, want)) or flat.tolist() != list(chain.from_iterable(want)):
                raise ValueError(f"agenda and library differ within {[words[k] for k in part]}")
            raw, stop = flat.astype(np.int32).tobytes(), (np.cumsum(counts) * 4).tolist()
            for k, s, e in zip(part, [0, *stop[:-1]], stop, strict=True):
                self.known[words[k]] = raw[s:e]

    @staticmethod
    def segments(text: str) -> list[str]:
        """The segments of a text, each without the U+2581 it begins with."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [m[1:] for m in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, n+1 offsets) of the texts; a null has no pieces."""
        out: list[bytes] = []
        waiting: list[tuple[list[str], list[bytes | None]]] = []
        new: set[str] = set()

        def settle() -> None:
            fresh: dict[str, bytes] = {}
            todo = list(new)
            for i in range(0, len(todo), REMEMBERED // 4):
                part = todo[i : i + REMEMBERED // 4]
                self.learn(part)
                fresh.update((w, self.known[w]) for w in part)
            for parts, values in waiting:
                if None in values:
                    values = [fresh[w] if v is None else v for w, v in zip(parts, values, strict=True)]
                out.append(b"".join(values))
            waiting.clear()
            new.clear()

        for text in texts:
            parts = self.segments(text) if text else []
            values = list(map(self.known.get, parts))
            if None in values:
                new.update(w for w, v in zip(parts, values, strict=True) if v is None)
            waiting.append((parts, values))
            if len(new) > REMEMBERED // 8:
                settle()
        settle()
        return np.frombuffer(b"".join(out), np.int32), np.cumsum([0, *map(len, out)]) // 4

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str] | pa.Array:
        """decode() of every ids[offsets[i]:offsets[i+1]]."""
        if self.rare[ids].any():
            return [self.decode(ids[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        which = ids.astype(np.int64)
        which[offsets[:-1][offsets[1:] > offsets[:-1]]] += len(self.text)
        size = self.length[which]
        stop = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.start[which] - stop[:-1], size) + np.arange(stop[-1])
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(stop[offsets]), pa.py_buffer(self.letters[at]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: spaces back, without the one in front; runs of byte pieces as UTF-8, invalid ones as U+FFFD."""
        if not len(ids):
            return ""
        if not self.rare[ids].any():
            text = "".join(map(self.plain.__getitem__, ids.tolist()))
            return text[1:] if self.text[ids[0]][0] == SPACE else text
        parts: list[str] = []
        raw = bytearray()
        begun = False
        for i in ids.tolist():
            if i in self.skip:
                if raw:
                    parts.append(raw.decode("utf-8", "each-byte"))
                    raw.clear()
                continue
            if i in self.value:
                raw.append(self.value[i])
                begun = True
                continue
            if raw:
                parts.append(raw.decode("utf-8", "each-byte"))
                raw.clear()
            piece = " \u2047 " if i == self.unknown else self.text[i].replace(SPACE, " ")
            parts.append(piece[1:] if not begun and i != self.unknown and piece[0] == " " else piece)
            begun = True
        if raw:
            parts.append(raw.decode("utf-8", "each-byte"))
        return "".join(parts)


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """One per process and model: it is read once however many tasks a worker runs."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Vocabulary(model)
    return _loaded[model]


def _encode_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                ids, offsets = vocab.encode(texts)
                none = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=none)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(offsets), pa.int64())], ["doc_id", "ids", "n_pieces"])

    return run


def _decode_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                offsets = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
                texts = vocab.decode_all(lists.flatten().to_numpy(zero_copy_only=False), offsets)
                texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string())
                if lists.null_count:
                    texts = pc.if_else(lists.is_valid(), texts, pa.nulls(len(texts), pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["doc_id", "text"])

    return run


def _shared(spark: SparkSession, model_path: str):
    """The model file, half a megabyte or so, to every executor: the path need only exist on the driver."""
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_pieces) of every row, with the pieces that the sentencepiece library gives.

    * a vocabulary that isn't of merge type with byte fallback, or that normalises texts, is an error;
    * null text: null ids, 0 pieces; empty text: no ids;
    * very long texts and words: encoded whole;
    * any character, control characters and U+2581 among them: as the library does;
    * ties: of pairs of equal score the leftmost is merged first;
    * repeated rows and null doc_ids: a result row each;
    * empty table: an empty result; other columns, of any name, are not read.
    """
    table, rid = numbered(docs)
    work = id_and_text(table, rid, id_col, text_col).select("doc_id", "text")
    return work.mapInArrow(_encode_batches(_shared(docs.sparkSession, model_path)), "doc_id long, ids array<int>, n_pieces long")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give null text, no ids an empty one.

    Control pieces vanish, unknown ones become U+2047 between spaces, and bytes
    that aren't UTF-8 become U+FFFD. For other cases see encode().
    """
    work = encoded.select(encoded[f"`{id_col}`"].cast("long").alias("doc_id"), encoded[f"`{ids_col}`"].cast("array<int>").alias("ids"))
    return work.mapInArrow(_decode_batches(_shared(encoded.sparkSession, model_path)), "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, n_pieces, text): every document encoded and decoded again, in one pass; cases as in encode()."""
    table, rid = numbered(docs)
    work = id_and_text(table, rid).select("doc_id", "text")
    model = _shared(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for encoded in _encode_batches(model)(batches):
            for decoded in _decode_batches(model)(iter([encoded.select(["doc_id", "ids"])])):
                yield pa.RecordBatch.from_arrays([*encoded.columns, decoded.column(1)], ["doc_id", "ids", "n_pieces", "text"])

    return work.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, text string")
