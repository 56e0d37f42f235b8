"""Language identification by a small convolutional network over bytes, in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed
length; each filter's maximum over the window goes through a ReLU to a softmax
over the languages and one class for what is no language. A text is cut into
windows end to end, the last one filled with zeros, so that all of it counts.

For use, embedding and filters fold into tables indexed by pairs of bytes: the
response of a filter is then a sum of one or two table rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaxis.llm.common import column, id_and_text, numbered
from lexaxis.llm.textbatch import buffer_of

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Bound of the labelled sample, in documents, whose texts count whole. Each label has an equal part of it, one document at least.
TRAIN_DOCS = 1200
#: Least mean probability of all languages together; below it a document is of no language.
MIN_CONFIDENCE = 0.2
UNKNOWN = "und"

_CHUNK = 1 << 11


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, document of each, bytes in each) of all texts; an empty text has none."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][doc] + within * WINDOW
    length = np.minimum(WINDOW, offsets[1:][doc] - start)
    at = np.arange(WINDOW)
    index = start[:, None] + at
    inside = at < length[:, None]
    out = np.where(inside, data[np.minimum(index, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(doc) else np.zeros((0, WINDOW), np.uint8)
    return out, doc, length


@dataclass
class ByteCNN:
    """The network; `labels` are its classes, the last one UNKNOWN."""

    labels: list[str]
    seed: int = 0
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.p:
            return
        random = np.random.default_rng(self.seed)
        normal = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"embed": random.normal(0, 0.3, (256, EMBEDDING)).astype(np.float32), "out": normal(FILTERS * len(WIDTHS), len(self.labels)), "out_b": np.zeros(len(self.labels), np.float32)}
        for w in WIDTHS:
            self.p[f"conv{w}"], self.p[f"conv{w}_b"] = normal(w * EMBEDDING, FILTERS), np.zeros(FILTERS, np.float32)

    # -- training -----------------------------------------------------------------------------

    def _step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross-entropy on windows x with classes y."""
        n, spots = len(x), WINDOW - max(WIDTHS) + 1
        embedded = self.p["embed"][x]
        pooled, where = [], []
        for w in WIDTHS:
            patch = np.concatenate([embedded[:, k : k + spots] for k in range(w)], axis=2)
            response = patch @ self.p[f"conv{w}"]
            where.append(response.argmax(1))
            pooled.append(np.take_along_axis(response, where[-1][:, None, :], 1)[:, 0] + self.p[f"conv{w}_b"])
        hidden = np.concatenate(pooled, axis=1)
        active = np.maximum(hidden, 0)
        logits = active @ self.p["out"] + self.p["out_b"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob *= (weight / weight.sum())[:, None]
        grad = {"out": active.T @ prob, "out_b": prob.sum(0), "embed": np.zeros_like(self.p["embed"])}
        back = (prob @ self.p["out"].T) * (hidden > 0)
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            seen = x[np.arange(n)[:, None, None], where[i][:, :, None] + np.arange(w)]  # n x filters x w
            patch = self.p["embed"][seen].reshape(n, FILTERS, w * EMBEDDING)
            grad[f"conv{w}"] = np.einsum("nf,nfd->df", g, patch)
            grad[f"conv{w}_b"] = g.sum(0)
            into = (g[:, :, None] * self.p[f"conv{w}"].T).reshape(n, FILTERS, w, EMBEDDING)
            np.add.at(grad["embed"], seen, into)
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 3, batch: int = 128, rate: float = 4e-3) -> ByteCNN:
        """Adam over shuffled batches; classes weigh alike however many windows each has."""
        random = np.random.default_rng(self.seed)
        share = np.bincount(y, minlength=len(self.labels)).astype(np.float32)
        weight = (1 / np.maximum(share, 1))[y]
        one, two, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = random.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                t += 1
                for k, g in self._step(x[pick], y[pick], weight[pick]).items():
                    one[k] += 0.1 * (g - one[k])
                    two[k] += 0.001 * (g * g - two[k])
                    self.p[k] -= rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)
        return self

    # -- use ----------------------------------------------------------------------------------

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows for the pair at a place, rows for the pair two places on, filter bias, output weights, bias)."""
        part = {(w, k): self.p["embed"] @ self.p[f"conv{w}"][k * EMBEDDING : (k + 1) * EMBEDDING] for w in WIDTHS for k in range(w)}
        pair = lambda a, b: (a[None, :, :] + b[:, None, :]).reshape(65536, FILTERS)  # noqa: E731  little-endian: first byte is low
        first = np.concatenate([pair(part[w, 0], part[w, 1]) for w in WIDTHS], axis=1)
        zero = np.zeros((256, FILTERS), np.float32)
        second = np.concatenate([pair(part[w, 2], part.get((w, 3), zero)) for w in WIDTHS if w > 2], axis=1)
        return np.ascontiguousarray(first), np.ascontiguousarray(second), np.concatenate([self.p[f"conv{w}_b"] for w in WIDTHS]), self.p["out"], self.p["out_b"]

    @staticmethod
    def probabilities(tables: tuple, x: np.ndarray) -> np.ndarray:
        first, second, bias, out, out_b = tables
        spots = WINDOW - max(WIDTHS) + 1
        result = np.empty((len(x), len(out_b)), np.float32)
        for at in range(0, len(x), _CHUNK):
            part = x[at : at + _CHUNK]
            pairs = part[:, :-1].astype(np.uint16) | (part[:, 1:].astype(np.uint16) << np.uint16(8))
            best = np.full((len(part), first.shape[1]), -np.inf, np.float32)
            # place by place over all windows: the working set stays in cache
            for i in range(spots):
                response = first[pairs[:, i]]
                response[:, FILTERS:] += second[pairs[:, i + 2]]
                np.maximum(best, response, out=best)
            logits = np.maximum(best + bias, 0) @ out + out_b
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            result[at : at + _CHUNK] = logits / logits.sum(1, keepdims=True)
        return result


def noise(windows: int, seed: int = 0) -> np.ndarray:
    """Windows of no language: random bytes, symbols, digits, hexadecimal and repeated characters."""
    random = np.random.default_rng(seed)
    alphabets = [np.arange(256), np.frombuffer(b"0123456789 .,-:/", np.uint8), np.frombuffer(b"0123456789abcdef", np.uint8), np.frombuffer(b"!#$%&*+-=<>|~^@_ ", np.uint8)]
    made = [random.choice(alphabets[i % len(alphabets)], WINDOW) if i % 5 else np.full(WINDOW, random.integers(256)) for i in range(windows)]
    return np.array(made, np.uint8).reshape(-1, WINDOW)


def _sample(docs: DataFrame, lang: Column, text: Column, max_docs: int) -> list:
    """Rows (lang, text): of each label the different texts of least hash, an equal number each."""
    labelled = docs.where(lang.isNotNull() & text.rlike("[^ ]")).select(lang.cast("string").alias("lang"), F.xxhash64(text).alias("mark"), text.cast("string").alias("text"))
    kinds = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).collect()}  # a row for each class
    if not kinds:
        return []
    quota, share = max(1, max_docs // len(kinds)), 4
    while True:
        # the hashes are even over 64 bits: below the limit there are some times the quota of a label's texts
        below = {k: min((1 << 63) - 1, (1 << 64) * share * quota // max(n, 1) - (1 << 63)) for k, n in kinds.items()}
        limit = F.create_map(*(F.lit(x) for pair in below.items() for x in pair))
        part = labelled.where(F.col("mark") <= limit[F.col("lang")])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
        rows = part.groupBy("lang", "mark").agg(F.min("text").alias("text")).withColumn("place", place).where(F.col("place") <= quota).orderBy("lang", "mark").select("lang", "text").collect()
        had = Counter(r.lang for r in rows)
        if all(had[k] == quota or below[k] == (1 << 63) - 1 for k in kinds):
            return rows
        share *= 16  # the number of different texts was estimated too high


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_docs: int = TRAIN_DOCS) -> ByteCNN | None:
    """A network for the languages that `docs` is labelled with, or None if no row is labelled.

    The sample is bounded by `max_docs` labelled documents, or one for each label
    if there are more labels than that: of each label, an equal number of
    different texts, those of least hash, whole. Rows without label or text don't count.
    """
    rows = _sample(docs, column(docs, lang_col), column(docs, text_col), max_docs)
    if not rows:
        return None
    labels = sorted({r.lang for r in rows})
    raw = [r.text.encode() for r in rows]
    x, doc, size = cut(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(b) for b in raw])])
    y = np.array([labels.index(r.lang) for r in rows])[doc]
    enough = (size >= WINDOW // 2) | (np.bincount(doc, minlength=len(rows))[doc] == 1)
    x, y = x[enough], y[enough]
    junk = noise(max(200, len(x) // 8))
    x, y = np.concatenate([x, junk]), np.concatenate([y, np.full(len(junk), len(labels))])
    # short texts: a third of the windows once more, cut off at a random place
    random = np.random.default_rng(1)
    short = random.permutation(len(x))[: len(x) // 3]
    x = np.concatenate([x, x[short] * (np.arange(WINDOW) < random.integers(4, WINDOW, len(short))[:, None])])
    y = np.concatenate([y, y[short]])
    return ByteCNN([*labels, UNKNOWN]).fit(x, y)


def _judge(tables: tuple, labels: list[str], min_confidence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(labels, dtype=object)
        for batch in batches:
            data, offsets = buffer_of(batch.column(2))
            n = batch.num_rows
            total = np.zeros((n, len(labels)))
            i = 0
            while i < n:  # by about 1 MB of text
                j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), side="right")) - 1))
                x, doc, length = cut(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(x):
                    np.add.at(total, doc + i, ByteCNN.probabilities(tables, x) * length[:, None])
                i = j
            size = np.diff(offsets)
            total[size > 0] /= size[size > 0, None]
            best = total[:, :-1].argmax(1)
            known = (size > 0) & (1 - total[:, -1] >= min_confidence)
            sure = np.where(known, total[np.arange(n), best], np.where(size > 0, total[:, -1], 0.0)) if n else np.zeros(0)
            said = np.where(known, names[best], UNKNOWN) if n else np.zeros(0, object)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said.tolist(), pa.string()), pa.array(np.round(sure, 4))], ["rid", "doc_id", "language", "confidence"])

    return run


def _judged(work: DataFrame, model: ByteCNN | None, min_confidence: float) -> DataFrame:
    if model is None:
        return work.select("rid", "doc_id", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"))
    return work.mapInArrow(_judge(model.tables(), model.labels, min_confidence), "rid long, doc_id long, language string, confidence double")


def identify(docs: DataFrame, model: ByteCNN | None = None, min_confidence: float = MIN_CONFIDENCE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, language, confidence) of every row; without a `model` one is trained on the labels of `docs`.

    The probabilities are means over all windows by their bytes. `language` is the
    likeliest language, or "und" where all languages together stay below
    `min_confidence`; `confidence` is the probability of what is said.

    * null or empty text: "und" at confidence 0;
    * very long text: all its windows count;
    * repeated rows and null doc_ids: a result row each; ties between languages: the first by name;
    * no labelled row at all: every document is "und" at 0;
    * empty table: an empty result; other columns, of any name, are not read.
    """
    model = model or train(docs, lang_col, text_col)
    table, rid = numbered(docs)
    return _judged(id_and_text(table, rid, id_col, text_col), model, min_confidence).drop("rid")


def keep_languages(docs: DataFrame, languages: list[str] | None = None, min_confidence: float = MIN_CONFIDENCE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs`, all columns, less the rows that are in none of `languages` (None: any that the labels name).

    Rejected are rows found "und", null and empty texts among them, or of
    another language. With nothing to train on, nothing is rejected.
    """
    model = train(docs, lang_col, text_col)
    if model is None:
        return docs
    mine = [x for x in model.labels[:-1] if languages is None or x in languages]
    judge, schema = _judge(model.tables(), model.labels, min_confidence), docs.schema
    order = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(order)
            none = pa.nulls(batch.num_rows, pa.int64())
            for said in judge(iter([pa.RecordBatch.from_arrays([none, none, text], ["rid", "doc_id", "text"])])):
                keep = np.isin(said.column(2).to_numpy(zero_copy_only=False), mine)
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
