"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

Words are lower-case runs of letters and digits (other bytes from 128 on count
as letters); a shingle is SHINGLE words in a row. Windows of every level overlap
by half: level j has windows of 2 * STRIDE * 2**j words, so that a notice of up
to STRIDE * 2**j + 1 words lies whole in one of that level. A window's MinHash
signature is the lesser of its two halves' ones. Each signature value is a band
of its own (one row): with a containment of at least THRESHOLD a template shares
a band with its window with a probability of at least 1 - (1 - J)**BANDS for
their Jaccard similarity J, which guarantee() gives per template. What is
retrieved is verified on the shingles themselves. A license has several notices:
the standard text or header, and short forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexaxis.llm.common import id_and_text, numbered
from lexaxis.llm.license_texts import TEMPLATES
from lexaxis.llm.textbatch import buffer_of, hash_spans, mix, slices, words

SHINGLE = 3
STRIDE = 4
BANDS = 48
THRESHOLD = 0.8

_PLAIN = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _PLAIN[_b] = _b
for _b in range(65, 91):
    _PLAIN[_b] = _b + 32
#: Places of a band's bit table.
_BITS = 1 << 15
_FACTOR = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = mix(np.arange(1001, BANDS + 1001, dtype=np.uint64))


def plain_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, position of the first word in its document) of every shingle."""
    data = _PLAIN[data]
    starts, ends, doc = words(data, offsets)
    h = hash_spans(data, starts, ends)
    n = len(h) - SHINGLE + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    whole = doc[:n] == doc[SHINGLE - 1 :]
    value = h[:n]
    for i in range(1, SHINGLE):
        value = mix(value * np.uint64(3) + h[i : n + i])
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    position = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
    return value[whole], doc[:n][whole], position[:n][whole]


def level_of(n_words: int) -> int:
    """The least level whose windows hold any run of that many words whole."""
    level = 0
    while (STRIDE << level) + 1 < n_words:
        level += 1
    return level


def guarantee(text: str, threshold: float = THRESHOLD) -> float:
    """The least probability that a window which contains `threshold` of a template retrieves it."""
    shingles = len(plain_words(text)) - SHINGLE + 1
    window = (2 * STRIDE << level_of(shingles + SHINGLE - 1)) - SHINGLE + 1
    held = int(np.ceil(threshold * shingles - 1e-9))
    return 1 - (1 - held / (window + shingles - held)) ** BANDS


class Scanner:
    """The templates' shingles by level, and a bit table of their bands."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float) -> None:
        self.threshold = threshold
        notices = [(name, text) for name in sorted(templates) for text in templates[name]]
        self.names = [name for name, _ in notices]
        self.levels: dict[int, list[int]] = {}
        self.shingles = []
        for i, (name, text) in enumerate(notices):
            count = len(plain_words(text))
            if count < SHINGLE:
                raise ValueError(f"a notice of {name} has fewer than {SHINGLE} words")
            raw = np.frombuffer(text.encode(), np.uint8)
            self.shingles.append(np.unique(shingled(raw, np.array([0, len(raw)]))[0]))
            self.levels.setdefault(level_of(count), []).append(i)
        own = {name: [x for x, n in zip(self.shingles, self.names, strict=True) if n == name] for name in templates}
        #: Pairs of licenses of which some notices have half their shingles in common, as versions of one license do.
        self.alike = {(a, b) for a in own for b in own if a != b and any(2 * len(np.intersect1d(x, y)) >= min(len(x), len(y)) for x in own[a] for y in own[b])}
        self.bands = {level: np.array([[(self.shingles[i] * _FACTOR[b] + _SHIFT[b]).min() for b in range(BANDS)] for i in own]) for level, own in self.levels.items()}
        self.table = {}
        for level, bands in self.bands.items():
            bits = np.zeros((BANDS, _BITS), bool)
            for b in range(BANDS):
                bits[b, (bands[:, b] >> np.uint64(3)).astype(np.int64) & (_BITS - 1)] = True
            self.table[level] = bits

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, str], tuple[float, int]]:
        """(document, license) -> (greatest containment, first word of the first window that has it).

        Of licenses that are alike, one whose window overlaps that of another with a greater containment doesn't count.
        """
        value, doc, position = shingled(data, offsets)
        found: dict[tuple[int, str], tuple[float, int, int]] = {}
        if not len(value):
            return found
        block = position // STRIDE
        start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])])
        minima = np.stack([np.minimum.reduceat(value * _FACTOR[b] + _SHIFT[b], start) for b in range(BANDS)])
        of, number, end = doc[start], block[start], np.r_[start[1:], len(value)]
        for level in range(max(self.levels) + 1):
            if level:  # two neighbours that make a block of this level
                head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (number[1:] // 2 != number[:-1] // 2)])
                minima = np.minimum.reduceat(minima, head, axis=1)
                end = np.r_[start[head[1:]], end[-1]]
                start, of, number = start[head], of[head], number[head] // 2
            if level not in self.levels:
                continue
            pair = np.r_[(of[1:] == of[:-1]) & (number[1:] == number[:-1] + 1), False]
            follow = np.where(pair, np.arange(len(of)) + 1, np.arange(len(of)))
            hit = np.zeros(len(of), bool)
            for b in range(BANDS):
                block_hit = self.table[level][b, (minima[b] >> np.uint64(3)).astype(np.int64) & (_BITS - 1)]
                hit |= block_hit  # the window's minimum is that of one of its halves
            for w in np.flatnonzero(hit | hit[follow]):
                signature = np.minimum(minima[:, w], minima[:, follow[w]])
                for row in np.flatnonzero((self.bands[level] == signature).any(axis=1)).tolist():
                    i = self.levels[level][row]
                    inside = value[start[w] : end[follow[w]]]
                    share = float(np.isin(self.shingles[i], inside).mean())
                    key, first = (int(of[w]), self.names[i]), int(number[w]) * (STRIDE << level)
                    if share >= self.threshold and (share, -first) > found.get(key, (0.0, 0))[:2]:
                        found[key] = (share, -first, first + (2 * STRIDE << level))
        by_doc: dict[int, list[tuple[str, float, int, int]]] = {}
        for (d, name), (share, first, stop) in found.items():
            by_doc.setdefault(d, []).append((name, share, -first, stop))
        return {
            (d, name): (share, first)
            for d, hits in by_doc.items()
            for name, share, first, stop in hits
            if not any((name, other) in self.alike and more > share and start < stop and first < end for other, more, start, end in hits)
        }


def _scan_batches(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            rows, names, shares, firsts = [], [], [], []
            for i, j in slices(offsets):
                for (doc, name), (share, first) in sorted(scanner.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).items()):
                    rows.append(i + doc)
                    names.append(name)
                    shares.append(round(share, 4))
                    firsts.append(first)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(firsts, pa.int64())], ["doc_id", "license", "containment", "first_word"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word) for each document and license of which a window contains a notice.

    `templates` has the notices of each license. `containment` is the share of a
    notice's distinct shingles in the window that has most of them, at least
    `threshold`; `first_word` is where the first such window begins. A notice of
    three to five words must stand there word for word. Of licenses whose notices
    have half their shingles in common, such as two versions of one, the lesser
    containment doesn't count where the windows overlap.

    * null, empty or short text (under three words): no results;
    * very long text: all its windows count;
    * repeated rows and null doc_ids: results of their own, like any row;
    * ties: a document with several licenses has a row for each; of equal windows, and of equal notices, the first counts;
    * empty table: an empty result; other columns, of any name, are not read.
    """
    table, rid = numbered(docs)
    work = id_and_text(table, rid, id_col, text_col).select("doc_id", "text")
    return work.mapInArrow(_scan_batches(Scanner(templates or TEMPLATES, threshold)), "doc_id long, license string, containment double, first_word long")
