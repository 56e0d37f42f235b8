"""Exact top-k search by MaxScore over document shards.

Scores are BM25 in whole millionths, so that sums don't depend on their order.
The documents are tokenised once, into an index in the shared folder: a row for
each shard of documents, with its terms and their postings as arrays. Queries go
in blocks against all shards. For a query the terms are ordered by the greatest
score that each can give in the shard; those whose bounds together stay below the
k-th best score so far are non-essential. Only the others' postings are
traversed; the rest are probed for the documents found, as long as these can
still compete. So a query of few; of a batch of queries those whose bounds together
stay below their k-th best leave the shard at once. Terms that many of the others
share and many documents hold are scored for the whole batch by one product of
matrices, in whole numbers that float64 holds exactly; their other lists are all
added, those of many queries at once. A few shards
are searched first: their k-th best scores are where the search of all others
begins, so that a shard sends only what can still be among the best. The shards'
best are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaxis.llm.common import bounded, column, id_and_text, numbered, scratch

K1, B = 1.2, 0.75
TOP_K = 10
#: Documents and bytes of text of a shard; a longer text is a shard by itself.
SHARD_DOCS = 1 << 13
SHARD_BYTES = 32 << 20
#: Bytes of text that are tokenised at once.
SLICE_BYTES = 4 << 20
#: Queries, and bytes of their text, of one pass over the index; more are further passes. Bounds what is broadcast; a longer query is a block by itself.
BLOCK_QUERIES = 6000
BLOCK_BYTES = 24 << 20
#: Non-essential lists that are probed between two looks at which documents can still compete, and the postings of one that are added rather than searched.
GROUP = 16
DENSE = 2000
#: Queries of a batch, postings that cost as much as this many entries of the product, and entries of the matrix of a batch's shared terms (8 bytes each); terms beyond are traversed.
BATCH = 128
GAIN = 64
SHARED = 1 << 22
#: Postings that are fetched at once, unless a single list has more.
FETCH = 1 << 16
#: Queries of a batch that are searched one by one rather than together.
FEW = 4
SCALE = 1_000_000

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\r\x0b\x0c"
_SPLIT = "[" + "".join(f"\\x{ord(c):02x}" for c in PUNCTUATION) + "]"
_INDEX = "rid array<long>, doc_id array<long>, length array<int>, words long, names binary, ends binary, starts binary, docs binary, times binary"


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms, text of each): lower-cased runs of characters other than ASCII punctuation and white space; a null text has none."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), _SPLIT, " ")
    lists = pc.split_pattern(plain, " ")
    each = lists.flatten()
    of = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    some = pc.not_equal(each, "")
    return each.filter(some), of[some.to_numpy(zero_copy_only=False)]


def counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, term, text, times): the last three by term, then text. Texts are cut SLICE_BYTES at a time, which bounds the memory it takes."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    names, terms, ofs, counts, at = [], [], [], [], 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        each, of = tokens(texts.slice(at, stop - at))
        coded = each.dictionary_encode()
        key, times = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (stop - at) + of, return_counts=True)
        names.append(coded.dictionary.cast(pa.large_string()))
        terms.append((key // (stop - at)).astype(np.int32))
        ofs.append((key % (stop - at) + at).astype(np.int32))
        counts.append(times.astype(np.uint32))
        at = stop
    if not names:
        return pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)
    whole = pa.concat_arrays(names).dictionary_encode()
    ids = whole.indices.to_numpy(zero_copy_only=False)
    starts = np.cumsum([0, *map(len, names)])
    term = np.concatenate([ids[s:][x] for s, x in zip(starts.tolist(), terms, strict=False)])
    order = np.argsort(term, kind="stable")  # slices ascend by text
    return whole.dictionary, term[order], np.concatenate(ofs)[order], np.concatenate(counts)[order]


def _index_row(rid: pa.Array, doc_id: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
    names, term, of, times = counted(texts)
    if not len(term):
        return None
    length = np.bincount(of, weights=times, minlength=len(texts)).astype(np.int32)
    some = length > 0  # documents without terms are no documents here
    names = names.cast(pa.large_string())
    _, ends, data = names.buffers()
    columns = {
        "rid": [rid.filter(pa.array(some)).to_pylist()],
        "doc_id": [doc_id.filter(pa.array(some)).to_pylist()],
        "length": [length[some].tolist()],
        "words": [int(length.sum())],
        "names": [data.to_pybytes()],
        "ends": [np.frombuffer(ends, np.int64)[: len(names) + 1].tobytes()],
        "starts": [np.searchsorted(term, np.arange(len(names) + 1)).astype(np.int64).tobytes()],
        "docs": [(np.cumsum(some) - 1)[of].astype(np.uint16).tobytes()],
        "times": [times.astype(np.uint32).tobytes()],
    }
    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], list(columns))


def _index(docs_a_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row():
            made = _index_row(*(pa.concat_arrays([b.column(i) for b in held]) for i in range(3)))
            held.clear()
            pa.default_memory_pool().release_unused()
            return [] if made is None else [made]

        rows = size = 0
        for batch in batches:
            bytes_ = pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                fits = int(np.searchsorted(np.cumsum(bytes_[at:]), SHARD_BYTES - size, side="right"))
                n = min(docs_a_shard - rows, fits, batch.num_rows - at)
                if n <= 0 and rows:
                    yield from row()
                    rows = size = 0
                    continue
                n = max(n, 1)
                held.append(batch.slice(at, n))
                rows, size, at = rows + n, size + int(bytes_[at : at + n].sum()), at + n
        if rows:
            yield from row()

    return run


class Shard:
    """Postings of a shard, of its i-th term those from starts[i] to starts[i + 1]; terms[i] is its number in a block's vocabulary, or -1."""

    def __init__(self, doc: np.ndarray, times: np.ndarray, starts: np.ndarray, terms: np.ndarray, length: np.ndarray, idf: np.ndarray, mean: float) -> None:
        self.size, self.doc, own = len(length), doc, terms >= 0
        self.start, self.end, self.top = np.zeros(len(idf), np.int64), np.zeros(len(idf), np.int64), np.zeros(len(idf))
        norm = K1 * (1 - B + B * length / mean)
        self.impact = times * (K1 + 1) / (times + norm[doc])
        self.impact *= np.repeat(np.where(own, idf[terms], 0.0), np.diff(starts))
        self.impact *= SCALE
        self.impact += 0.5
        np.floor(self.impact, out=self.impact)
        self.start[terms[own]], self.end[terms[own]] = starts[:-1][own], starts[1:][own]
        if len(doc):
            self.top[terms[own]] = np.maximum.reduceat(np.r_[self.impact, 0.0], starts[:-1])[own]

    def _sums(self, places: list[tuple[int, int, int]]) -> np.ndarray:
        """What lists of postings, each so many times, give every document."""
        docs = np.concatenate([self.doc[s:e] for s, e, _ in places])
        return np.bincount(docs, np.concatenate([self.impact[s:e] if n == 1 else self.impact[s:e] * n for s, e, n in places]), self.size)

    def shared(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(terms that are cheaper scored for all these queries at once, what they give: queries x documents)."""
        each = np.concatenate([terms for terms, _ in queries])
        terms, uses = np.unique(each, return_counts=True)
        gain = uses * (self.end[terms] - self.start[terms]) * GAIN
        worth = np.flatnonzero(gain >= len(queries) * self.size)
        worth = np.sort(worth[np.argsort(-gain[worth], kind="stable")[: SHARED // max(1, self.size)]])
        terms = terms[worth]
        if not len(terms):
            return terms, np.zeros((len(queries), 0))
        matrix = np.zeros((len(terms), self.size))
        for row, s, e in zip(matrix, self.start[terms].tolist(), self.end[terms].tolist(), strict=True):
            row[self.doc[s:e]] = self.impact[s:e]
        at = np.minimum(np.searchsorted(terms, each), len(terms) - 1)
        of = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        own = terms[at] == each
        asked = np.zeros((len(queries), len(terms)))
        asked[of[own], at[own]] = np.concatenate([n for _, n in queries])[own]
        return terms, asked @ matrix

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, ids: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best that score `floor` at least; equal scores rank by `ids`, whose values are distinct."""
        some = self.end[terms] > self.start[terms]
        terms, times = terms[some], times[some]
        bound = self.top[terms] * times
        order = np.argsort(bound)
        upto = np.r_[0.0, np.cumsum(bound[order])]  # upto[i]: bound of the first i lists together
        places = list(zip(self.start[terms[order]].tolist(), self.end[terms[order]].tolist(), times[order].tolist(), strict=True))
        first = int(np.searchsorted(upto[1:], floor, side="left"))  # lists before it are non-essential
        if first == len(places):
            return np.zeros(0, np.int64), np.zeros(0)
        score = self._sums(places[first:])
        found = np.flatnonzero(score >= max(floor - upto[first], 0.5))
        while first and len(found):
            last, first = first, max(0, first - GROUP)
            group = places[first:last]
            if sum(e - s for s, e, _ in group) < GROUP * (DENSE + 8 * len(found)):
                score += self._sums(group)  # short lists are added whole, which costs less than looking for each document
            else:
                for s, e, n in group:
                    at = np.minimum(np.searchsorted(self.doc[s:e], found), e - s - 1) + s
                    score[found] += np.where(self.doc[at] == found, self.impact[at] * n, 0.0)
            found = found[score[found] + upto[first] >= floor]
        return self._best(score, found[score[found] >= max(floor, 1.0)], k, ids)

    def finish(self, begun: np.ndarray, terms: np.ndarray, times: np.ndarray, k: int, ids: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """search() for a query whose other terms give every document what `begun` says; all lists of `terms` are added."""
        score = begun.copy()
        self._add(score[None], np.zeros(len(terms), np.int64), self.start[terms], self.end[terms], times)
        return self._best(score, np.flatnonzero(score >= max(floor, 1.0)), k, ids)

    @staticmethod
    def _best(score: np.ndarray, found: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = score[found]
        if len(found) > 4 * k:  # only what reaches the k-th best is sorted
            keep = scores >= np.partition(scores, -k)[-k]
            found, scores = found[keep], scores[keep]
        top = np.lexsort((ids[found], -scores))[:k]
        return found[top], scores[top]


    def bounds(self, terms: np.ndarray, times: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """What each of several queries, terms[cut[i] : cut[i + 1]], can give a document at most."""
        return np.diff(np.r_[0.0, np.cumsum(self.top[terms] * times)][cut])

    def batch(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, ids: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, scores) of each query that has any here: search() for all at once."""
        cut = np.cumsum([0, *(len(t) for t, _ in queries)])
        terms, times = (np.concatenate([q[i] for q in queries]) for i in (0, 1))
        able = np.flatnonzero(self.bounds(terms, times, cut) >= np.maximum(floors, 1.0))  # the others' lists, all together, stay below the k-th best
        if len(able) <= FEW:
            for q in able.tolist():
                found, scores = self.search(*queries[q], k, ids, floors[q])
                if len(found):
                    yield q, found, scores
            return
        if len(able) < len(queries):
            of = np.repeat(np.arange(len(queries)), np.diff(cut))
            some = np.isin(of, able)
            terms, times, cut = terms[some], times[some], np.cumsum([0, *np.diff(cut)[able]])
        shared, score = self.shared([queries[q] for q in able.tolist()])
        rest = self.end[terms] > self.start[terms]
        if len(shared):
            rest &= shared[np.minimum(np.searchsorted(shared, terms), len(shared) - 1)] != terms
        else:
            score = np.zeros((len(able), self.size))
        row = np.repeat(np.arange(len(able)), np.diff(cut))[rest]
        self._add(score, row, self.start[terms[rest]], self.end[terms[rest]], times[rest])
        hits = score >= np.maximum(floors[able], 1.0)[:, None]
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            yield int(able[i]), *self._best(score[i], np.flatnonzero(hits[i]), k, ids)

    def _add(self, score: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, times: np.ndarray) -> None:
        """Adds lists of postings, each so many times, to rows of `score`, which ascend; FETCH postings at once, or a single list."""
        size = end - start
        upto = np.cumsum(size)
        at = 0
        while at < len(size):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + FETCH, side="right")))
            n, first, last = size[at:stop], int(row[at]), int(row[stop - 1]) + 1
            place = np.repeat(start[at:stop] - np.cumsum(n) + n, n)
            place += np.arange(len(place))
            to = np.repeat((row[at:stop] - first) * self.size, n)
            to += self.doc[place]
            score[first:last] += np.bincount(to, self.impact[place] * np.repeat(times[at:stop], n), (last - first) * self.size).reshape(last - first, self.size)
            at = stop


def _names(row: dict) -> pa.Array:
    ends = pa.py_buffer(row["ends"])
    return pa.LargeStringArray.from_buffers(len(row["ends"]) // 8 - 1, ends, pa.py_buffer(row["names"]))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Row by row, since a shard's row has some megabytes."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _statistics(vocabulary):
    """(term, n): in how many documents each term of the broadcast vocabulary is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        found = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in _rows(batch):
                at = pc.index_in(_names(row), terms).fill_null(-1).to_numpy(zero_copy_only=False)
                found[at[at >= 0]] += np.diff(np.frombuffer(row["starts"], np.int64))[at >= 0]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "n"])

    return run


def _search(block, mean: float, k: int):
    """`block` is broadcast: (vocabulary, idf, [(terms, times)], floors, queries in the order of their batches)."""
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, queries, floors, turn = block.value
        floors = floors.copy()
        for batch in batches:
            for row in _rows(batch):
                at = pc.index_in(_names(row), vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                rid, length = np.array(row["rid"]), np.array(row["length"])
                shard = Shard(np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["times"], np.uint32), np.frombuffer(row["starts"], np.int64), at, length, idf, mean)
                doc_id = np.array([none if x is None else x for x in row["doc_id"]])
                order = np.empty(len(rid), np.int64)
                order[np.lexsort((rid, doc_id))] = np.arange(len(rid))
                docs, scores, of = [], [], []
                for start in range(0, len(turn), BATCH):
                    asked = turn[start : start + BATCH]
                    for i, d, s in shard.batch([queries[q] for q in asked], k, order, floors[asked]):
                        q = asked[i]
                        docs.append(d)
                        scores.append(s)
                        of.append(np.full(len(d), q))
                        if len(d) == k:
                            floors[q] = max(floors[q], s.min())
                if docs:
                    place = pa.array(np.concatenate(docs))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(of)), pa.array(rid).take(place), pa.array(row["doc_id"], pa.int64()).take(place), pa.array(np.concatenate(scores).astype(np.int64))],
                        ["query", "rid", "doc_id", "score"],
                    )

    return run


_FOUND = "query long, rid long, doc_id long, score long"
_RESULT = "item_id long, doc_id long, score long, rank int"


def _block(index: DataFrame, seeds: int, shards: int, n: int, mean: float, items: list, texts: list, k: int, to: str) -> None:
    """Writes the result rows of one block of queries to `to`."""
    spark = index.sparkSession
    vocabulary, term, of, times = counted(pa.array(texts, pa.string()))
    if not len(vocabulary):
        return
    sent = spark.sparkContext.broadcast(vocabulary.cast(pa.large_string()))
    sums = index.select("names", "ends", "starts").mapInArrow(_statistics(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # the block's terms
    df = np.zeros(len(vocabulary))
    df[sums["term"].to_numpy()] = sums["n"].to_numpy()
    idf = np.where(df > 0, np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0)
    by_query = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[by_query], np.arange(len(texts) + 1))
    queries = [(term[by_query[s:e]], times[by_query[s:e]]) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    floors = np.zeros(len(texts))
    often = [int(t[np.argmax(df[t])]) if len(t) else -1 for t, _ in queries]  # texts of a language mostly have the same most frequent term
    turn = [q for q in np.argsort(often, kind="stable").tolist() if often[q] >= 0]
    best = lambda rows, upto: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "rid"))).where(F.col("rank") <= upto)
    parts = index.withColumn("seed", F.pmod(F.xxhash64(F.get("rid", F.lit(0))), F.lit(shards)) < seeds) if seeds < shards else index.withColumn("seed", F.lit(True))
    sent_all = spark.sparkContext.broadcast((sent.value, idf, queries, floors, turn))
    at = scratch(spark, "seeds")
    best(parts.where("seed").drop("seed").mapInArrow(_search(sent_all, mean, k), _FOUND), k).drop("rank").write.parquet(at)
    found = spark.read.schema(_FOUND).parquet(at)
    if seeds < shards:
        for r in found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k).collect():  # a row a query
            floors[r.query] = r.low
        sent_more = spark.sparkContext.broadcast((sent.value, idf, queries, floors, turn))
        found = found.unionByName(parts.where("not seed").drop("seed").mapInArrow(_search(sent_more, mean, k), _FOUND))
    names = spark.createDataFrame(list(enumerate(items)), "query long, item_id long")
    best(found, k).join(bounded(names, len(items), 32), "query").select("item_id", "doc_id", "score", "rank").write.mode("append").parquet(to)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, doc_id, score, rank): for every row of `queries`, its `k` best documents by BM25 in millionths.

    Every term of a query counts, as often as it occurs. Documents that share no
    term with it aren't results, so a query can have fewer than `k`.

    * ties: by doc_id (nulls last), then by file order; the ranks are 1 to k without gaps;
    * null, empty or wordless text: as a query no results; as a document it isn't counted in the statistics;
    * very long texts count whole, on either side;
    * repeated rows: documents each by itself; queries each with its own ranks;
    * null ids are carried; empty tables give an empty result; other columns, of any name, are not read.
    """
    spark = docs.sparkSession
    table, rid = numbered(docs)
    at, to = scratch(spark, "index"), scratch(spark, "found")
    id_and_text(table, rid, id_col, text_col).mapInArrow(_index(SHARD_DOCS), _INDEX).write.parquet(at)
    index = spark.read.schema(_INDEX).parquet(at)
    shards, n, words = index.agg(F.count("*"), F.sum(F.size("rid")), F.sum("words")).first()
    spark.createDataFrame([], _RESULT).write.parquet(to)
    if shards:
        seeds = max(1, int(np.sqrt(shards)))
        asked = queries.select(column(queries, query_id).cast("long").alias("item_id"), column(queries, query_text).cast("string").alias("text")).where("text is not null")
        run = lambda items, texts: _block(index, seeds, shards, n, words / n, items, texts, k, to)
        items, texts, size = [], [], 0
        for row in asked.toLocalIterator():
            if items and (len(items) == BLOCK_QUERIES or size + len(row.text) > BLOCK_BYTES):
                run(items, texts)
                items, texts, size = [], [], 0
            items.append(row.item_id)
            texts.append(row.text)
            size += len(row.text)
        if items:
            run(items, texts)
    return spark.read.schema(_RESULT).parquet(to)


def oracle(k: int = TOP_K, queries: str = "select doc_id as item_id, text from documents where doc_id % 50 = 0") -> str:
    """The same by scoring every document that shares a term, in SQL."""
    quoted = PUNCTUATION.replace("'", "''")
    split = f"string_split(translate(lower(text), '{quoted}', '{' ' * len(PUNCTUATION)}'), ' ')"
    return f"""
    with d as (select doc_id, unnest({split}) as t from documents),
    w as (select doc_id, t from d where t <> ''),
    l as (select doc_id, count(*) as n from w group by doc_id),
    s as (select count(*) as docs, sum(n) / count(*) as mean from l),
    f as (select doc_id, t, count(*) as tf from w group by doc_id, t),
    df as (select t, count(*) as df from f group by t),
    q as (select item_id, t, count(*) as times from (select item_id, unnest({split}) as t from ({queries})) where t <> '' group by item_id, t),
    p as (select item_id, f.doc_id, times * cast(floor({SCALE} * (ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * n / mean)))) + 0.5) as bigint) as points
          from q join f on q.t = f.t join df on q.t = df.t join l on f.doc_id = l.doc_id, s),
    r as (select item_id, doc_id, sum(points) as score from p group by item_id, doc_id),
    o as (select item_id, doc_id, cast(score as bigint) as score, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from r where score > 0)
    select item_id, doc_id, score, rank from o where rank <= {k}
    """
