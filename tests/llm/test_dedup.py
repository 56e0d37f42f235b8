"""SimHash groups, exact duplicates, line dedup and the cuckoo filter."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexaxis.llm import exact_dedup, line_dedup, simhash
from lexaxis.llm.common import scratch
from lexaxis.llm.cuckoo import CuckooFilter
from lexaxis.llm.graph import components


def groups_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def prints_of(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts, pa.string())], ["rid", "doc_id", "text"])
    out = next(simhash._fingerprint_batches(iter([batch])))
    fp = np.frombuffer(b"".join(out.column(2).to_pylist()), np.uint64).reshape(-1, simhash.BITS // 64)
    return out.column(0).to_pylist(), fp


def test_near_duplicates_against_all_pairs(docs):
    rows = docs.orderBy("doc_id").collect()
    at, fp = prints_of([r.text for r in rows])
    close = [(rows[at[i]].doc_id, rows[at[j]].doc_id) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]).sum(1) <= simhash.MAX_DISTANCE) + i + 1]
    want = {x: r for x, r in groups_of(close).items() if x != r}
    found = {r.doc_id: r.duplicate_of for r in simhash.near_duplicates(docs).collect()}
    assert len(want) > 10
    assert len(set(found.items()) & set(want.items())) >= 0.9 * len(want)
    assert set(found) <= set(want)


def test_close_pairs_within_the_blocks_are_found_for_certain():
    random = np.random.default_rng(0)
    base = random.integers(0, 1 << 63, (200, 8), dtype=np.uint64)
    for row in base:
        bits = np.unpackbits(row.view(np.uint8))
        bits[random.choice(simhash.BITS, simhash.BLOCKS - 1, replace=False)] ^= 1
        assert (np.packbits(bits).view(np.uint16) == row.view(np.uint16)).any()


def test_near_duplicates_of_hard_rows(nasty, empty):
    found = sorted(((r.doc_id, r.duplicate_of) for r in simhash.near_duplicates(nasty).collect()), key=str)
    assert found == [(1, 1), (6, 5), (9, 1), (None, None)]
    kept = simhash.drop_near_duplicates(nasty)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 4
    assert simhash.near_duplicates(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


def test_buckets_large_and_small_give_the_same_groups():
    random = np.random.default_rng(1)
    heads = random.integers(0, 1 << 63, (5, 8), dtype=np.uint64)
    fp = heads[random.integers(0, 5, 150)] ^ (np.uint64(1) << random.integers(0, 63, (150, 8), dtype=np.uint64))
    u, v = simhash.bucket_edges(np.zeros(150, np.int64), np.arange(150), fp, 20)
    want = groups_of((i, j) for i in range(150) for j in range(i) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= 20)
    assert groups_of(zip(u.tolist(), v.tolist(), strict=True)) == want


@pytest.mark.parametrize("least, left, right, settle", [(1 << 10, 1536, 2048, 1 << 16), (16, 9, 7, 5)])
def test_close_pairs_that_share_no_block_of_bits_are_linked(spark, monkeypatch, least, left, right, settle):
    for name, value in (("BLOCK_LEAST", least), ("LEFT", left), ("RIGHT", right), ("SETTLE", settle)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    random = np.random.default_rng(2)
    heads = random.integers(0, 1 << 63, (120, 8), dtype=np.uint64)
    near = np.unpackbits(heads[:80].view(np.uint8), axis=1)
    for i, row in enumerate(near):
        for b in range(32):  # three bits of each sixteen: 96 in all
            row[16 * b + random.choice(16, 3, replace=False)] ^= 1
        if i % 4 == 0:
            row[np.flatnonzero(row == np.unpackbits(heads[i].view(np.uint8)))[0]] ^= 1  # and 97
    fp = np.concatenate([heads, np.packbits(near, axis=1).view(np.uint64)])
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(fp)] + [(500, None)], "node long, fp binary")
    found = {(r.u, r.v) for r in simhash.close_edges(nodes).collect()}
    assert found == {(120 + i, i) for i in range(80) if i % 4}


def test_many_near_copies_in_several_buckets_are_one_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_LEAST", 32)
    random = np.random.default_rng(3)
    fp = random.integers(0, 1 << 63, (1, 8), dtype=np.uint64) ^ (np.uint64(1) << random.integers(0, 63, (300, 8), dtype=np.uint64))
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(np.unique(fp, axis=0))], "node long, fp binary")
    edges = simhash.close_edges(nodes)
    assert edges.count() <= 10 * 300
    assert {r.root for r in components(edges).collect()} == {0}


@pytest.mark.parametrize("limit", [0, 1, 20, 97, 253, 254, 512])
def test_links_are_those_of_all_pairs_at_any_limit(limit):
    random = np.random.default_rng(limit)
    bits = random.integers(0, 2, (60, 512), dtype=np.uint8)
    for i in range(10, 50):
        bits[i] = bits[i % 10]
        bits[i, random.choice(512, min(512, max(0, limit + random.integers(-1, 2))), replace=False)] ^= 1
    bits[50], bits[51] = 0, 1
    fp = np.packbits(bits, axis=1).view(np.uint64)
    want = groups_of((i, j) for i in range(60) for j in range(i + 1) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= limit)
    assert simhash._roots(fp, 0, limit).tolist() == [want[i] for i in range(60)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 51)} | {101: 100, 102: 100, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(0, (1 << 44) - 1)))
def test_golomb_round_trip(values):
    ordered = np.array(sorted(values), np.uint64)
    k, code = exact_dedup.golomb_encode(ordered, 1 << 44)
    assert exact_dedup.golomb_decode(len(ordered), k, code).tolist() == ordered.tolist()


def test_exact_duplicates_of_hard_rows(nasty, empty):
    found = sorted(((r.doc_id, r.duplicate_of) for r in exact_dedup.exact_duplicates(nasty).collect()), key=str)
    assert found == [(1, 1), (6, 5), (9, 1), (None, None)]
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_equal_fingerprints_alone_are_no_duplicates(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(*c) * 0)
    assert exact_dedup.exact_duplicates(rows).count() == 0


@given(st.lists(st.integers(0, (1 << 33) - 1), min_size=1))
def test_packed_row_numbers(values):
    assert exact_dedup._unpacked(exact_dedup._packed(np.array(values, np.int64))).tolist() == values


def test_different_texts_of_one_digest_are_no_duplicates(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"t{i % 30}") for i in range(40)] + [(None, "t3")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.unhex(F.lit("00")))
    found = {(r.doc_id, r.duplicate_of) for r in exact_dedup.exact_duplicates(rows).collect()}
    assert found == {(30 + i, i) for i in range(10)} | {(None, 3)}


def test_copies_of_a_frequent_text_are_spread(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i, "" if i % 3 else f"t{i % 60}") for i in range(300)], "doc_id long, text string")
    first = {}
    for i in range(300):
        first.setdefault("" if i % 3 else f"t{i % 60}", []).append(i)
    want = {(i, own[0]) for own in first.values() for i in own[1:]}
    found = [(r.doc_id, r.duplicate_of) for r in exact_dedup.exact_duplicates(rows).collect()]
    assert len(found) == len(set(found)) and set(found) == want


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=300, unique=True), st.data())
def test_cuckoo_filter(keys, data):
    keys = np.array(keys, np.uint64)
    made = CuckooFilter.for_keys(len(keys))
    made.insert(keys)
    assert made.contains(keys).all()
    out = np.array(data.draw(st.lists(st.booleans(), min_size=len(keys), max_size=len(keys))))
    made.delete(keys[out])
    again = CuckooFilter.from_bytes(made.to_bytes())
    assert again.contains(keys[~out]).all()
    again.delete(keys[~out])
    assert not again.table.any() and not again.stash


def test_cuckoo_filter_seldom_finds_what_it_does_not_hold():
    made = CuckooFilter.for_keys(20_000)
    made.insert(np.arange(20_000, dtype=np.uint64))
    assert made.contains(np.arange(1 << 20, (1 << 20) + 20_000, dtype=np.uint64)).mean() < 0.001
    with pytest.raises(KeyError):
        CuckooFilter(4).delete(np.array([1], np.uint64))


def test_line_dedup_of_hard_rows(nasty, empty):
    kept = line_dedup.dedup_lines(nasty)
    assert kept.columns == nasty.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    texts = {i: t for i, t in rows if i is not None}
    assert sorted(texts) == [1, 2, 3, 4, 5, 7, 8]
    assert (texts[1], texts[2], texts[3], texts[4]) == ("eins zwei drei\nvier\n\nfünf", None, "", "   \n\t\n ")
    assert len(rows) == 9 and len(texts[7]) == 300_000
    assert line_dedup.dedup_lines(empty).count() == 0


def brute(live):
    """Lines by owner over (batch, doc_id, text) in order."""
    seen, counts = {}, {}
    for batch, doc_id, text in live:
        for i, line in enumerate(text.split("\n")):
            if line.strip(" "):
                counts[line] = counts.get(line, 0) + 1
                seen.setdefault(line, []).append((batch, doc_id, i))
    return {line: min(at)[1:] for line, at in seen.items()}, counts


def test_insertions_and_deletions_are_reversible(spark):
    import hashlib

    batches = [[(i + 10 * b, "\n".join(f"l{(i * 3 + k * b) % 17}" for k in range(5)) + f"\n\nown{i}{b}") for i in range(8)] for b in range(3)]
    store = line_dedup.LineStore(spark, scratch(spark, "store"), shards=3)
    live = []

    def check():
        owners, counts = brute(live)
        key = lambda line: hashlib.md5(line.encode()).digest()
        assert {bytes(r.line): r.refs for r in store.counts().collect()} == {key(x): n for x, n in counts.items()}
        assert {bytes(r.line): (r.doc_id, r.line_no) for r in store.owned().collect()} == {key(x): own for x, own in owners.items()}
        for r in store.filters().collect():
            held = [np.frombuffer(key(x)[:8], np.uint64)[0] for x in counts]
            made = CuckooFilter.from_bytes(r.filter)
            own = [h for h, x in zip(held, counts, strict=True) if int(key(x)[:4].hex(), 16) % 3 == r.shard]
            assert made.contains(np.array(own, np.uint64)).all()
            assert int((made.table != 0).sum()) + len(made.stash) == len(own)

    for b, rows in enumerate(batches):
        shown = store.insert(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        known = set(brute(live)[1])
        live += [(b, d, t) for d, t in rows]
        fresh = [x for r in shown for x in r.text.split("\n") if x]
        assert len(fresh) == len(set(fresh)) and set(fresh) == set(brute(live)[1]) - known
        check()
    for gone in ([0, 11, 999], [0, 1, 2, 3, 20], list(range(40))):
        store.delete(spark.createDataFrame([(g,) for g in [*gone, gone[0], None]], "doc_id long"))
        live = [x for x in live if x[1] not in gone]
        check()
    shown = store.insert(spark.createDataFrame(batches[0], "doc_id long, text string")).collect()
    live = [(5, d, t) for d, t in batches[0]]
    assert {x for r in shown for x in r.text.split("\n") if x} == set(brute(live)[1])


def test_line_store_is_reopened_and_survives_a_lost_step(spark, monkeypatch):
    path = scratch(spark, "store")
    batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    line_dedup.LineStore(spark, path, shards=3).insert(batch((1, "a\nb"), (2, "c")))
    store = line_dedup.LineStore(spark, path)
    assert store.shards == 3
    assert texts(store.insert(batch((3, "a\nd"), (4, "c")))) == [(3, "d")]

    def lost(*_):
        raise RuntimeError("lost")

    state = lambda x: {bytes(r.line): r.refs for r in x.counts().collect()}
    before = state(store)
    with monkeypatch.context() as m:
        m.setattr(store, "_refilter", lost)
        for step in (lambda: store.insert(batch((5, "e"))), lambda: store.delete(batch((1, "")).select("doc_id"))):
            with pytest.raises(RuntimeError, match="lost"):
                step()
            assert state(store) == state(line_dedup.LineStore(spark, path)) == before
    assert texts(store.insert(batch((5, "e\nd")))) == [(5, "e")]
    store = line_dedup.LineStore(spark, path)
    store.delete(batch((1, ""), (2, "")).select("doc_id"))
    assert texts(line_dedup.LineStore(spark, path).insert(batch((6, "a\nb\nc")))) == [(6, "b")]


def test_time_of_assembly_follows_the_lines(spark):
    import time

    took = []
    for n in (4_000, 16_000, 64_000):
        docs = spark.createDataFrame([(1, "\n".join(f"line {i}" if i % 3 else "same" for i in range(n)))], "doc_id long, text string")
        kept = line_dedup.dedup_lines(docs)
        began = time.perf_counter()
        assert len(kept.first().text.split("\n")) == n - len(range(0, n, 3)) + 1
        took.append(time.perf_counter() - began)
    assert took[2] < 8 * took[1] + 2 and took[1] < 5


def test_ownership_that_is_handed_over(spark):
    docs = spark.createDataFrame([(0, "a\nb"), (2, "a\nc\n\nb"), (1, "a\nd\nc"), (3, "d"), (10, "a\nnew"), (None, "c\nn")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_dedup.replay(docs).collect()}
    # 0 and 10 went and came back last: their lines passed to 2, and only `new` is theirs again
    assert found == {2: "a\nc\n\nb", 1: "d", 10: "new", None: "n"}


def test_replay_of_hard_rows(nasty, empty):
    kept = line_dedup.replay(nasty)
    assert kept.columns == nasty.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(nasty).collect() if r.doc_id not in (1,)), key=repr)
    assert [x for x in found if x[0] not in (1, 9, 5, 6)] == [x for x in want if x[0] not in (5, 6)]
    assert line_dedup.replay(empty).count() == 0
