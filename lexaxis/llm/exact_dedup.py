"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each file split sorts its texts' fingerprints, cuts them by owner (a range of
the fingerprint space) and sends the gaps, Golomb-coded. An owner counts the
fingerprints of all senders and answers each with a bitmap: which of its
fingerprints, in their order, occur more than once. Only the rows so marked are
suspects. Their texts alone are shuffled, and compared byte for byte: by digest,
the least and the greatest text of a group must be the same one, so that copies
collapse before the shuffle however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaxis.llm.common import bounded, id_and_text, numbered, settled

#: Bits of a fingerprint that are exchanged. A chance match only makes a suspect more.
FINGERPRINT_BITS = 48
#: Fingerprints that an owner is meant to get; more rows make more owners.
OWNER_ROWS = 1 << 20
#: Copies of one text that are joined with their first by one task.
HOT_ROWS = 100_000

_ROW_BITS = 33


def golomb_encode(sorted_values: np.ndarray, span: int) -> tuple[int, bytes]:
    """(parameter k, code): gaps of ascending values below `span`, in Golomb code of modulus 2**k.

    The unary quotients come first, then the remainders of k bits, so that both are decoded as arrays.
    """
    n = len(sorted_values)
    gaps = np.diff(sorted_values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, 0.69 * span / max(n, 1)))))
    unary = np.ones(int((gaps >> np.uint64(k)).sum()) + n, np.uint8)
    unary[np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1] = 0
    places = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return k, np.array([len(unary)], np.int64).tobytes() + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(n: int, k: int, code: bytes) -> np.ndarray:
    """The `n` ascending values of a code."""
    if n == 0:
        return np.zeros(0, np.uint64)
    size = int(np.frombuffer(code, np.int64, 1)[0])
    raw = np.frombuffer(code, np.uint8, offset=8)
    zeros = np.flatnonzero(np.unpackbits(raw[: -(-size // 8)], count=size) == 0)
    gaps = (np.diff(zeros, prepend=-1) - 1).astype(np.uint64)
    rest = np.unpackbits(raw[-(-size // 8) :], count=n * k).reshape(n, k)
    for b in range(k):
        gaps = (gaps << np.uint64(1)) | rest[:, b].astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _packed(numbers: np.ndarray) -> bytes:
    """A byte for the width, then the numbers in that many bytes each, the low ones first."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    each = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    out = np.zeros((len(each), 8), np.uint8)
    out[:, : raw[0]] = each
    return out.view("<i8").ravel()


def _send(owner_bits: int):
    low = FINGERPRINT_BITS - owner_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        rid, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        fp = fp.view(np.uint64) >> np.uint64(64 - FINGERPRINT_BITS)
        for split in np.unique(rid >> _ROW_BITS):
            mine = np.flatnonzero(rid >> _ROW_BITS == split)
            mine = mine[np.argsort(fp[mine], kind="stable")]
            owner = (fp[mine] >> np.uint64(low)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
            rows = []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                value = fp[mine[s:e]] & np.uint64((1 << low) - 1)
                k, code = golomb_encode(value, 1 << low)
                rows.append((int(split), int(owner[s]), int(e - s), k, code, _packed(rid[mine[s:e]] & ((1 << _ROW_BITS) - 1))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["split", "owner", "n", "k", "code", "rows"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    values = [golomb_decode(n, k, code) for n, k, code in zip(*(table[c].to_pylist() for c in ("n", "k", "code")), strict=True)]
    _, inverse, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    cut = np.cumsum([0, *(len(v) for v in values)])
    maps = [np.packbits(twice[s:e]).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"split": table["split"].cast(pa.int64()), "owner": table["owner"].cast(pa.int64()), "twice": pa.array(maps, pa.binary())})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for split, rows, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            index = _unpacked(rows)
            marked = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(index)).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(index[marked] | (split << _ROW_BITS))], ["rid"])


def suspects(prints: DataFrame, owner_bits: int) -> DataFrame:
    """(rid) of the rows of (rid, fp) whose fingerprint isn't the only one of its kind."""
    sent = settled(prints.mapInArrow(_send(owner_bits), "split long, owner long, n long, k long, code binary, rows binary"))
    answers = sent.select("split", "owner", "n", "k", "code").groupBy("owner").applyInArrow(_answer, "split long, owner long, twice binary")
    return sent.select("split", "owner", "rows").join(answers, ["split", "owner"]).select("split", "rows", "twice").mapInArrow(_suspects, "rid long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of): every document whose text an earlier one has byte for byte, with the first such.

    The first has the least doc_id.

    * null text: no text, hence no duplicate; empty texts are equal;
    * very long text: compared whole;
    * repeated rows: copies of each other, so each but one gives (id, id);
    * null doc_id: sorts last; ties between equal doc_ids: the earlier row in the files is first;
    * empty table: an empty result; other columns, of any name, are not read.
    """
    table, rid = numbered(docs)
    work = id_and_text(table, rid, id_col, text_col).where("text is not null")
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), table.count() // OWNER_ROWS)
    found = settled(suspects(work.select("rid", F.xxhash64("text").alias("fp")), max(1, (owners - 1).bit_length())))
    mine = work.join(bounded(found, found.count(), 24), "rid", "left_semi").withColumn("digest", _digest("text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    same = settled(mine.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.min(order).alias("first"), F.count("*").alias("n")).select("digest", "first", "n", (F.col("low") == F.col("high")).alias("one")))
    pairs = _with_first(mine.select("digest", "doc_id", "rid"), same.where("one and n > 1"))
    if same.where("not one").isEmpty():
        return pairs
    # different texts of one digest: by the texts themselves
    mixed = mine.join(same.where("not one").select("digest"), "digest", "left_semi").withColumn("digest", F.encode("text", "utf-8"))
    return pairs.unionByName(_with_first(mixed.select("digest", "doc_id", "rid"), settled(mixed.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"))))


def _digest(text: str):
    return F.unhex(F.md5(text))


def _with_first(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of) of the rows (digest, doc_id, rid) that aren't the first of their group; rows of a text that is very frequent are spread."""
    hot = groups.where(F.col("n") > HOT_ROWS).select("digest", F.ceil(F.col("n") / HOT_ROWS).alias("parts"))
    hot = settled(hot)
    if hot.isEmpty():
        joined = rows.join(groups, "digest")
    else:
        spread = rows.join(bounded(hot, hot.count(), 48), "digest", "left").withColumn("part", F.pmod("rid", F.coalesce("parts", F.lit(1)))).drop("parts")
        copies = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / HOT_ROWS) - 1)))
        joined = spread.join(copies, ["digest", "part"])
    return joined.where("rid <> first.rid").select("doc_id", F.col("first.doc_id").alias("duplicate_of"))
