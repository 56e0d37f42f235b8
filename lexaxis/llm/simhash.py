"""Near-duplicate documents by SimHash fingerprints, all of them compared with all.

A document's fingerprint has BITS bits. Its features are its distinct words;
each bit is the majority of that bit over the features' hashes. Two documents
are *close* if at most `max_distance` bits differ. The distinct fingerprints
fall into blocks of rows, and each two blocks meet in one bucket, so that no
close pair is missed. A bucket is compared in tiles: the distance in the first
FIRST bits comes, three rows at once, from one product of matrices, and only
pairs that are within the limit there are settled on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaxis.llm.common import id_and_text, numbered, settled, without_rows
from lexaxis.llm.graph import components
from lexaxis.llm.textbatch import mix, word_hashes

BITS = 512
MAX_DISTANCE = 96
#: Blocks of rows, and the least and greatest number of rows of one: fewer blocks for small tables, more for very large ones. A row is sent as many times.
BLOCKS = 16
BLOCK_LEAST, BLOCK_MOST = 1 << 10, 1 << 18
#: Bits that are compared first. A product's sums, of three rows in eight bits each, stay below 2**24 for up to 253, where float32 is exact.
FIRST = 253
#: Rows of a tile on the left (a multiple of three) and on the right, and pairs that are settled at once.
LEFT, RIGHT, SETTLE = 1536, 2048, 1 << 16

_WORDS = BITS // 64
_SPREAD = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).view(np.uint64).ravel()
_SALTS = mix(np.arange(1, _WORDS + 1, dtype=np.uint64))


def fingerprint_rows(doc: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints as rows x BITS/8 bytes, whether a row has any word)."""
    out = np.zeros((rows, BITS // 8), np.uint8)
    some = np.zeros(rows, bool)
    if len(doc) == 0:
        return out, some
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    key = key[np.r_[True, key[1:] != key[:-1]]]
    owner = (key >> np.uint64(44)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    ids, counts = owner[first], np.diff(np.r_[first, len(owner)])
    some[ids] = True
    # byte-wide counters hold 255 additions: a segment is at most that long
    in_doc = np.arange(len(owner)) - np.repeat(first, counts)
    segment = np.flatnonzero(in_doc % 255 == 0)
    of_doc = np.searchsorted(segment, first)
    feature = key & np.uint64((1 << 44) - 1)
    for k in range(_WORDS):
        spread = _SPREAD[mix(feature ^ _SALTS[k]).view(np.uint8)].reshape(-1, 8)
        partial = np.add.reduceat(spread, segment, axis=0).view(np.uint8).astype(np.int32)
        ones = np.add.reduceat(partial, of_doc, axis=0)
        out[ids, 8 * k : 8 * k + 8] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little")
    return out, some


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        prints, some = np.zeros((n, BITS // 8), np.uint8), np.zeros(n, bool)
        for i, j, doc, hashes in word_hashes(batch.column(2)):
            prints[i:j], some[i:j] = fingerprint_rows(doc, hashes, j - i)
        fp = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), n, [None, pa.py_buffer(prints)])
        keep = pa.array(some)
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (batch.column(0), batch.column(1), fp.cast(pa.binary()))], ["rid", "doc_id", "fp"])


def fingerprints(work: DataFrame) -> DataFrame:
    """(rid, doc_id, fp) of every row of (rid, doc_id, text) that has at least one word."""
    return work.mapInArrow(_fingerprint_batches, "rid long, doc_id long, fp binary")


def _first_bits(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first bits as 0 and 1, half the number of ones rounded down)."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, count=FIRST, bitorder="little")
    return bits, bits.sum(1, dtype=np.int32) // 2


def _left(fp: np.ndarray) -> np.ndarray:
    """Operand of a third of the rows: row q holds rows q, q + third and q + 2 * third, times 1, 2**8 and 2**16."""
    third = -(-len(fp) // 3)
    each = np.zeros((3 * third, FIRST + 3), np.float32)
    each[: len(fp), :FIRST], half = _first_bits(fp)
    each[: len(fp), FIRST], each[: len(fp), FIRST + 1] = 128 - half, 1
    return each[:third] + 256 * each[third : 2 * third] + 65536 * each[2 * third :]


def _right(fp: np.ndarray) -> np.ndarray:
    each = np.zeros((len(fp), FIRST + 3), np.float32)
    each[:, :FIRST], half = _first_bits(fp)
    each[:, FIRST], each[:, FIRST + 1] = 1, -half
    return each.T


def _perhaps(left: np.ndarray, right: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the left and right tile whose first bits differ in at most `max_distance`, or one or two more; of the left there can be up to two too many.

    An eight bits' sum is 128 + ones in common - half the ones of either side,
    that is 128 less half the distance, rounded up or one more.
    """
    sums = np.matmul(left, right).astype(np.int32)
    sums += (min(max_distance, FIRST) // 2) * 0x010101
    sums &= 0x808080
    flat = sums.ravel()
    if len(flat) % 2 == 0:  # looked through two at a time
        two = np.flatnonzero(flat.view(np.int64)) * 2
        at = np.concatenate([two, two + 1])
    else:
        at = np.flatnonzero(flat)
    hits = flat[at]
    third, width = sums.shape
    q, j = np.divmod(at, width)
    own = [np.flatnonzero(hits & (128 << (8 * k))) for k in range(3)]
    return np.concatenate([q[x] + k * third for k, x in enumerate(own)]), np.concatenate([j[x] for x in own])


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of rows i and j; root[x] is the least row of x's component, before and after."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _roots(fp: np.ndarray, cut: int, max_distance: int) -> np.ndarray:
    """The least row of each row's component, by the close pairs of a row before `cut` and one from there on, or of all rows if cut is 0.

    Pairs that are joined already aren't settled, so that thousands of near
    copies give no more than a link each.
    """
    root = np.arange(len(fp))
    lefts = [(at, _left(fp[at : min(at + LEFT, cut or len(fp))])) for at in range(0, cut or len(fp), LEFT)]
    for start in range(cut, len(fp), RIGHT):
        stop = min(start + RIGHT, len(fp))
        right = _right(fp[start:stop])
        for at, left in lefts:
            if at >= stop:
                break
            i, j = _perhaps(left, right, max_distance)
            i, j = i + at, j + start
            own = i < min(at + LEFT, cut or len(fp))
            i, j = i[own], j[own]
            for s in range(0, len(i), SETTLE):
                x, y = i[s : s + SETTLE], j[s : s + SETTLE]
                apart = root[x] != root[y]
                x, y = x[apart], y[apart]
                near = np.bitwise_count(fp[x] ^ fp[y]).sum(1, dtype=np.int32) <= max_distance
                _join(root, x[near], y[near])
    return root


def bucket_edges(key: np.ndarray, node: np.ndarray, fp: np.ndarray, max_distance: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, bucket by bucket, just what the close pairs of that bucket connect; each component is a star.

    `key` is sorted. In a bucket that has rows of two sides, 0 before 1, the
    pairs are those of different sides, else all.
    """
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
        cut = 0 if side is None or side[s] == side[e - 1] else int(np.searchsorted(side[s:e], 1))
        root = _roots(fp[s:e], cut, max_distance)
        found = np.flatnonzero(root != np.arange(e - s))
        us.append(node[s + found])
        vs.append(node[s + root[found]])
    u, v = np.concatenate(us), np.concatenate(vs)
    return np.maximum(u, v), np.minimum(u, v)


def _edge_batches(max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settle(parts):
            key, side, node, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, v = bucket_edges(key, node, fp, max_distance, side)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, side, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            raw = batch.column(3).cast(pa.binary(BITS // 8))
            fp = np.frombuffer(raw.buffers()[1], np.uint8)[raw.offset * BITS // 8 :][: batch.num_rows * BITS // 8].view(np.uint64).reshape(-1, _WORDS)
            part = key, side, node, fp
            cut = int(np.searchsorted(key, key[-1], side="left"))  # the last bucket may go on in the next batch
            if cut or (held and held[-1][0][-1] != key[0]):
                if held and cut == 0:
                    yield settle(held)
                else:
                    yield settle([*held, tuple(x[:cut] for x in part)])
                held = []
            held.append(tuple(x[cut:] for x in part))
        if held:
            yield settle(held)

    return run


def close_edges(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (u, v) among distinct fingerprints (fp, node): their components are those of all close pairs.

    Nodes are numbers that differ; copies have one fingerprint and hence one
    node. `nodes` is read twice, so it should be settled. A null fingerprint or
    an empty table gives no edge. Every row goes to as many buckets as there are
    blocks, and a bucket is a task; the work grows as the square of the rows.
    """
    nodes = nodes.where("fp is not null")
    rows = nodes.count()
    blocks = max(min(BLOCKS, -(-rows // BLOCK_LEAST)), -(-rows // BLOCK_MOST), 1)
    own = nodes.select("node", "fp", F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("own"))
    both = own.select("node", "fp", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("other"))
    key = "greatest(own, other) * (greatest(own, other) + 1) div 2 + least(own, other)"
    placed = both.select(F.expr(key).alias("key"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "fp")
    by_bucket = placed.repartitionById(blocks * (blocks + 1) // 2, F.col("key").cast("int"))
    return by_bucket.sortWithinPartitions("key", "side").mapInArrow(_edge_batches(max_distance), "u long, v long")


def _groups(work: DataFrame, max_distance: int) -> DataFrame:
    """(rid, doc_id, keep_rid, keep_id) of each row that another row of its group stands for."""
    prints = settled(fingerprints(work))
    nodes = settled(prints.groupBy("fp").agg(F.min("rid").alias("node")))
    roots = components(close_edges(nodes, max_distance))
    members = prints.join(nodes, "fp").join(roots, "node", "left").select("rid", "doc_id", F.coalesce("root", "node").alias("label"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    heads = members.groupBy("label").agg(F.count("*").alias("n"), F.min(order).alias("head")).where("n > 1")
    return members.join(heads, "label").where("rid <> head.rid").select("rid", "doc_id", F.col("head.rid").alias("keep_rid"), F.col("head.doc_id").alias("keep_id"))


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of): every document that is not the first of its near-duplicate group, with the first.

    A group is a connected component of the close pairs; its first is the row
    with the least doc_id. Exact copies are close at distance 0.

    * null or wordless text: has no fingerprint, is never in a result;
    * very long text: all its words count;
    * repeated rows: copies of each other, so each but one gives (id, id);
    * null doc_id: sorts last, so it is first only in a group of such rows;
    * ties: between equal doc_ids, the earlier row in the files is first;
    * empty table: an empty result; other columns, of any name, are not read.
    """
    table, rid = numbered(docs)
    return _groups(id_and_text(table, rid, id_col, text_col), max_distance).select("doc_id", F.col("keep_id").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all columns, with one row of each near-duplicate group: the first, as in near_duplicates().

    Rows without words all stay; for other cases see near_duplicates().
    """
    table, rid = numbered(docs)
    return without_rows(table, rid, settled(_groups(id_and_text(table, rid, id_col, text_col), max_distance).select("rid")))
