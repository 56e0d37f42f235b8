"""Packing, WARC, SentencePiece, language ID, search, shards, licenses and the pipeline."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lexaxis.llm import langid, licenses, packing, pieces, sharding, simhash, topk, warc
from lexaxis.llm.common import scratch
from lexaxis.llm.queries import MODEL


# -- packing ------------------------------------------------------------------------------------


def check_packs(rows, texts, context):
    """Every token of every text exactly once, no pack above the context."""
    parts = {}
    for r in rows:
        assert r.tokens == sum(p.tokens for p in r.pieces) <= context
        for p in r.pieces:
            parts.setdefault(p.doc_id, []).append((p.first_token, p.first_token + p.tokens))
    want = {}
    for doc_id, text in texts:
        n = len([w for w in (text or "").split() if w])
        want[doc_id] = want.get(doc_id, 0) + n
    assert {d: sum(e - s for s, e in own) for d, own in parts.items()} == {d: n for d, n in want.items() if n}
    return parts


def test_every_token_is_packed_once(docs):
    rows = docs.collect()
    for context in (64, packing.CONTEXT):
        found = packing.pack(docs, context).collect()
        parts = check_packs(found, [(r.doc_id, r.text) for r in rows], context)
        for own in parts.values():
            own.sort()
            assert own[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(own))
        assert [r.pack_id for r in sorted(found, key=lambda r: r.pack_id)] == list(range(len(found)))
        tokens = sum(r.tokens for r in found)
        assert len(found) <= 1.1 * -(-tokens // context) + 1


def test_packing_hard_rows(nasty, empty):
    check_packs(packing.pack(nasty, 100).collect(), [(r.doc_id, r.text.replace("▁", "x") if r.text else r.text) for r in nasty.collect()], 100)
    assert packing.pack(empty).count() == 0


def placed_by(plan, context):
    found = Counter()
    for config, many in plan:
        assert sum(size * n for size, n in config) <= context
        for size, n in config:
            found[size] += n * many
    return found


def plain_best_fit(histogram, context):
    sizes = np.array(sorted(histogram), np.int64)
    return sum(n for _, n in packing.best_fit_decreasing(sizes, np.array([histogram[int(x)] for x in sizes], np.int64), context))


@settings(deadline=None, max_examples=25)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_plan_places_every_length_and_is_near_the_dual_bound(histogram):
    plan, bound = packing.solve(histogram, 40, 60)
    assert placed_by(plan, 40) == histogram
    assert bound >= sum(size * n for size, n in histogram.items()) / 40 - 1e-6
    assert bound - 1e-6 <= sum(n for _, n in plan) <= plain_best_fit(histogram, 40) + len(histogram) + 1


def optimum(items, context):
    """Least number of contexts by dynamic programming over subsets: (contexts, fill of the last one)."""
    best = {0: (1, 0)}
    for held in range(1 << len(items)):
        for i, size in enumerate(items):
            if not held >> i & 1 and held in best:
                n, used = best[held]
                new = (n, used + size) if used + size <= context else (n + 1, size)
                both = held | 1 << i
                best[both] = min(best.get(both, new), new)
    return best[(1 << len(items)) - 1][0]


def test_plans_against_the_optimum_of_small_histograms():
    source, equal = random.Random(4), 0
    for _ in range(60):
        items = [source.randrange(1, 21) for _ in range(source.randrange(1, 11))]
        plan, bound = packing.solve(Counter(items), 20)
        least, n = optimum(items, 20), sum(many for _, many in plan)
        assert bound - 1e-6 <= least <= n <= least + 1
        equal += n == least
    assert equal >= 55


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_program_carries_the_packing_of_the_documents(spark, sf):
    rests = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select((F.size(F.array_remove(F.split("text", r"\s+"), "")) % packing.CONTEXT).alias("n")).where("n > 0")
    histogram = {r.n: r["count"] for r in rests.groupBy("n").count().collect()}
    plan, bound = packing.solve(histogram, packing.CONTEXT)
    n = sum(many for _, many in plan)
    assert placed_by(plan, packing.CONTEXT) == histogram
    assert n <= np.ceil(bound - 1e-6) + 1 and n <= plain_best_fit(histogram, packing.CONTEXT)
    counts = np.zeros(packing.CONTEXT + 1, np.int64)
    counts[list(histogram)] = list(histogram.values())
    own, left, dual = packing.program(counts)
    assert own.total() > 0.4 * n and dual <= bound
    assert set(own) <= {config for config, _ in plan} and (left >= 0).all()


def test_linear_program_beats_best_fit_where_that_is_known_to_be_bad():
    plan, bound = packing.solve({7: 60, 10: 60, 23: 60}, 40)
    assert sum(n for _, n in plan) == 60 == round(bound)


def test_prices_find_a_bound_that_volume_does_not():
    plan, bound = packing.solve({21: 100, 22: 50}, 40)
    assert sum(n for _, n in plan) == 150 and bound == pytest.approx(150, abs=5)


# -- WARC ---------------------------------------------------------------------------------------


def test_warc_selected_records_and_hard_rows(spark):
    rows = [(1, "http://a.example/ü %41\n", "<p>x</p>"), (1, "http://a.example/ü %41\n", "<p>x</p>"), (None, None, None), (2, "http://b.example/", ""), (3, "u", "y" * 9_000_000), (4, "v", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, rid int")
    found = warc.round_trip(spark, pages).collect()
    assert sorted(((r.page_id, r.url, r.html) for r in found), key=repr) == sorted(rows, key=repr)
    index = warc.write_warc(pages, scratch(spark, "w"))
    assert sorted(map(repr, warc.index_warc(index.select("file").distinct()).collect())) == sorted(map(repr, index.collect()))
    got = warc.read_records(index.where("page_id in (1, 4)").withColumn("part", F.lit("x"))).collect()
    assert sorted(r.page_id for r in got) == [1, 1, 4]
    assert warc.write_warc(pages.limit(0), scratch(spark, "w")).count() == 0
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_every_member_can_be_read_by_its_offset(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = warc.write_warc(pages, scratch(spark, "w")).collect()
    for r in rows:
        system, path = warc.open_path(r.file)
        with system.open_input_file(path) as f:
            headers, body = warc.parse(zlib.decompress(f.read_at(r.length, r.offset), 31))
        assert headers["warc-payload-digest"] == r.digest == warc.digest_of(body)


def test_records_of_other_writers(spark, tmp_path):
    import base64
    import gzip
    import hashlib

    body = "<p>été</p>".encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + body
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    heads = {
        "digest": f"WARC-Type: response\r\nWARC-Target-URI: <http://a.example/>\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{sha1}",
        "none": "WARC-Type: response\r\nWARC-Target-URI: http://b.example/\r\nContent-Type: application/http;msgtype=response",
        "wrong": "WARC-Type: response\r\nWARC-Target-URI: http://c.example/\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:AAAA",
    }
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n"
    members = [gzip.compress(info)] + [gzip.compress(f"WARC/1.0\r\n{h}\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n") for h in heads.values()]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    index = warc.index_warc(spark.createDataFrame([(f"file://{tmp_path}/{f}.warc.gz",) for f in ("f", "empty")], "file string"))
    rows = sorted(index.collect(), key=lambda r: r.offset)
    assert [(r.url, r.digest) for r in rows] == [(None, None), ("http://a.example/", f"sha1:{sha1}"), ("http://b.example/", None), ("http://c.example/", "sha1:AAAA")]
    good = warc.read_records(index.where("coalesce(digest, '') <> 'sha1:AAAA'")).collect()
    assert sorted((r.url or "", r.html, r.digest) for r in good) == [("", "a: b\r\n", warc.digest_of(b"a: b\r\n")), ("http://a.example/", "<p>été</p>", f"sha1:{sha1}"), ("http://b.example/", "<p>été</p>", warc.digest_of(body))]
    with pytest.raises(Exception, match="digest mismatch"):
        warc.read_records(index.where("digest = 'sha1:AAAA'")).collect()


@given(st.lists(st.tuples(st.integers(0, 100_000), st.integers(1, 3_000_000)), max_size=30))
def test_coalesced_reads_cover_the_ranges(gaps):
    at, ranges = 0, []
    for gap, length in gaps:
        ranges.append((at + gap, length))
        at += gap + length
    reads = list(warc.coalesced(ranges))
    assert [r for _, _, inside in reads for r in inside] == ranges
    for start, length, inside in reads:
        assert start == inside[0][0] and start + length == max(o + n for o, n in inside)
        assert length <= warc.READ_BYTES or len(inside) == 1


# -- SentencePiece ------------------------------------------------------------------------------


def test_pieces_are_the_librarys_and_come_back(spark, nasty, empty, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for table in (docs, nasty):
        for r in pieces.round_trip(table, MODEL).join(table.select("doc_id", F.col("text").alias("raw")), "doc_id").dropDuplicates(["doc_id"]).collect():
            assert r.ids == (None if r.raw is None else library.encode(r.raw))
            assert r.text == (None if r.raw is None else library.decode(r.ids))
            assert r.n_pieces == len(r.ids or [])
    assert pieces.round_trip(empty, MODEL).count() == 0
    assert pieces.round_trip(nasty, MODEL).count() == nasty.count()


@settings(deadline=None, max_examples=200)
@given(st.text(st.one_of(st.sampled_from(" ▁ab\n\x00é😀"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    with open(MODEL, "rb") as f:
        vocab = pieces.vocabulary(f.read())
    ids, _ = vocab.encode([text])
    assert ids.tolist() == vocab.library.encode(text)
    assert vocab.decode(ids) == vocab.library.decode(ids.tolist())


def test_decoding_any_ids(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    source = random.Random(0)
    lists = [[source.randrange(32_000) for _ in range(source.randrange(20))] for _ in range(200)] + [None, [], [0, 1, 2], [5, 200, 130], [28705, 1]]
    found = pieces.decode(spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>"), MODEL).collect()
    assert [r.text for r in sorted(found, key=lambda r: r.doc_id)] == [None if x is None else library.decode(x) for x in lists]


# -- language ID --------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 and lang is not null")
    found = langid.identify(rest, model).join(rest.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in found) / len(found) > 0.95
    kept = langid.keep_languages(docs)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()


def test_noise_is_no_language(spark, docs):
    source = random.Random(1)
    rows = [(i, "".join(source.choice("0123456789 #$%&|~^") for _ in range(400))) for i in range(20)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")), langid.train(docs)).collect()
    assert sum(r.language == langid.UNKNOWN for r in found) >= 19


def test_language_of_hard_rows(nasty, empty, docs):
    model = langid.train(docs)
    found = langid.identify(nasty, model).collect()
    assert len(found) == nasty.count()
    assert {r.doc_id: (r.language, r.confidence) for r in found if r.doc_id in (2, 3)} == {2: ("und", 0.0), 3: ("und", 0.0)}
    assert langid.identify(empty).count() == langid.keep_languages(empty).count() == 0
    assert {r.language for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_network(model, x):
    embedded, pooled = model.p["embed"][x], []
    spots = langid.WINDOW - max(langid.WIDTHS) + 1
    for w in langid.WIDTHS:
        patch = np.concatenate([embedded[:, k : k + spots] for k in range(w)], axis=2)
        pooled.append((patch @ model.p[f"conv{w}"]).max(1) + model.p[f"conv{w}_b"])
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ model.p["out"] + model.p["out_b"]
    want = np.exp(logits - logits.max(1, keepdims=True))
    return want / want.sum(1, keepdims=True)


def test_folded_tables_are_the_network():
    model = langid.ByteCNN(["a", "b", "und"], seed=3)
    x = np.random.default_rng(0).integers(0, 256, (50, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(langid.ByteCNN.probabilities(model.tables(), x), plain_network(model, x), atol=1e-4)


def test_identify_is_the_mean_of_the_plain_network_over_all_windows(docs, spark):
    model = langid.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.orderBy(F.length("text").desc()).limit(3).collect()] + [(-1, "kurz"), (-2, "é" * 100)]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc_id, text in rows:
        raw, total = text.encode(), np.zeros(len(model.labels))
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            total += plain_network(model, np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)[None])[0] * len(part) / len(raw)
        known = 1 - total[-1] >= langid.MIN_CONFIDENCE
        assert found[doc_id].language == (model.labels[int(total[:-1].argmax())] if known else langid.UNKNOWN)
        assert found[doc_id].confidence == pytest.approx(total[:-1].max() if known else total[-1], abs=2e-4)


def test_languages_that_tie_and_rare_ones(spark):
    model = langid.ByteCNN(["a", "b", "und"])
    model.p["out"][:] = 0
    assert langid.identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), model).first().language == "a"
    rows = [(i, "der hund und die katze " * 3, "de") for i in range(300)] + [(i, f"{i} el perro y el gato {i} " * 4, "es") for i in range(300)] + [(999, "ο σκύλος και η γάτα " * 9, "el")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid._sample(docs, docs.lang, docs.text, 30)
    assert Counter(r.lang for r in sample) == {"de": 1, "es": 10, "el": 1}
    assert langid.train(docs, max_docs=30).labels == ["de", "el", "es", "und"]


# -- search -------------------------------------------------------------------------------------


@pytest.mark.parametrize(("group", "dense"), [(1, -10_000), (2, 0), (16, 2000)])
def test_maxscore_is_exhaustive_search(monkeypatch, group, dense):
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "DENSE", dense)
    source = np.random.default_rng(2)
    n, vocab = 200, 30
    lengths = source.integers(1, 40, n)
    doc = np.repeat(np.arange(n), lengths)
    term = np.minimum(source.zipf(1.5, len(doc)) - 1, vocab - 1)
    key, times = np.unique(term * n + doc, return_counts=True)
    cut = np.searchsorted(key // n, np.arange(vocab + 1))
    shard = topk.Shard(key % n, times, cut, np.arange(vocab), lengths, source.random(vocab) * 5, lengths.mean())
    ids = source.permutation(n)
    for k in (1, 5, 300):
        for _ in range(20):
            asked = np.unique(source.integers(0, vocab, 6))
            count = source.integers(1, 3, len(asked))
            score = np.zeros(n)
            for t, c in zip(asked, count, strict=True):
                score[shard.doc[cut[t] : cut[t + 1]]] += shard.impact[cut[t] : cut[t + 1]] * c
            hit = np.flatnonzero(score)
            order = hit[np.lexsort((ids[hit], -score[hit]))][:k]
            for floor in (0.0, *score[order[-1:]] / 2, *score[order[-1:]]):
                found, scores = shard.search(asked, count, k, ids, floor)
                assert found.tolist() == order.tolist() and scores.tolist() == score[order].tolist()


@pytest.mark.parametrize(("gain", "entries"), [(64, 1 << 22), (10**9, 1 << 22), (10**9, 1400)])
def test_terms_that_queries_share_are_scored_at_once(monkeypatch, gain, entries):
    monkeypatch.setattr(topk, "GAIN", gain)
    monkeypatch.setattr(topk, "SHARED", entries)
    monkeypatch.setattr(topk, "FETCH", 300)
    source = np.random.default_rng(4)
    n, vocab = 200, 60
    key, times = np.unique(np.minimum(source.zipf(1.4, 5000) - 1, vocab - 1) * n + source.integers(0, n, 5000), return_counts=True)
    cut = np.searchsorted(key // n, np.arange(vocab + 1))
    lengths = np.bincount(key % n, times, n)
    shard = topk.Shard(key % n, times, cut, np.arange(vocab), lengths, source.random(vocab) * 5, lengths.mean())
    ids = source.permutation(n)
    queries = [(x, source.integers(1, 3, len(x))) for x in (np.unique(source.integers(0, vocab, 12)) for _ in range(40))]
    terms, given = shard.shared(queries)
    assert 0 < len(terms) <= entries // n
    for (asked, count), begun in zip(queries, given, strict=True):
        rest = ~np.isin(asked, terms)
        for k in (1, 5, 300):
            plain, best = shard.search(asked, count, k, ids)
            for floor in (0.0, *best[-1:] / 2, *best[-1:]):
                found, scores = shard.finish(begun, asked[rest], count[rest], k, ids, floor)
                assert found.tolist() == plain.tolist() and scores.tolist() == best.tolist()


@pytest.mark.parametrize(("gain", "few", "fetch"), [(64, 0, 300), (10**9, 0, 1 << 18), (0, 4, 1), (64, 100, 300)])
def test_a_batch_is_searched_as_its_queries_are(monkeypatch, gain, few, fetch):
    monkeypatch.setattr(topk, "GAIN", gain)
    monkeypatch.setattr(topk, "FEW", few)
    monkeypatch.setattr(topk, "FETCH", fetch)
    source = np.random.default_rng(7)
    n, vocab = 300, 90
    of = np.arange(n) % 3  # three languages of 30 terms, with three terms in common
    docs = np.repeat(np.arange(n), 15)
    words = (source.zipf(1.4, len(docs)) - 1) % 30
    key, times = np.unique(np.where(words < 27, words * 3 + of[docs], words * 3) * n + docs, return_counts=True)
    cut, terms = np.searchsorted(key // n, np.arange(vocab + 1)), np.where(np.arange(vocab) % 10 == 9, -1, np.arange(vocab))
    lengths, idf = np.bincount(key % n, times, n), source.random(vocab) * 5
    whole = topk.Shard(key % n, times, cut, terms, lengths, idf, lengths.mean())
    rank = source.permutation(n)
    queries = [(x[x % 10 != 9], source.integers(1, 3, (x % 10 != 9).sum())) for x in (np.unique(source.integers(0, vocab, 12)) for _ in range(40))]
    for k in (1, 5, 300):
        plain = [whole.search(t, x, k, rank) for t, x in queries]
        for floors in (np.zeros(40), np.array([s[-1] if len(s) else 0.0 for _, s in plain])):
            found = {q: (d.tolist(), s.tolist()) for q, d, s in whole.batch(queries, k, rank, floors)}
            assert [found.get(q, ([], [])) for q in range(40)] == [(d.tolist(), s.tolist()) for d, s in plain]


def test_a_batch_leaves_a_shard_that_can_give_too_little(monkeypatch):
    doc, starts = np.array([0, 1, 2, 3]), np.array([0, 2, 4])
    shard = topk.Shard(doc, np.ones(4), starts, np.arange(2), np.ones(4), np.ones(2), 1.0)
    monkeypatch.setattr(topk.Shard, "shared", lambda *_: pytest.fail("the shard was searched"))
    monkeypatch.setattr(topk.Shard, "search", lambda *_: pytest.fail("the shard was searched"))
    assert list(shard.batch([(np.array([0, 1]), np.array([1, 1]))] * 9, 2, np.arange(4), np.full(9, 1e9))) == []


def test_search_of_hard_rows(spark, nasty, empty):
    queries = spark.createDataFrame([(1, "eins drei!"), (1, "eins drei!"), (2, None), (3, ""), (None, "nummer"), (4, "nichtda")], "item_id long, text string")
    found = topk.search(nasty, queries, 2).collect()
    assert sorted((r.item_id, r.doc_id, r["rank"]) for r in found if r.item_id) == [(1, 1, 1), (1, 1, 1), (1, 1, 2), (1, 1, 2)]
    assert [(r.doc_id, r["rank"]) for r in found if r.item_id is None] == [(None, 1), (None, 2)]
    assert topk.search(empty, queries).count() == topk.search(nasty, queries.limit(0)).count() == 0


def test_many_queries_go_in_blocks(spark, docs, monkeypatch):
    queries = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, topk.search(docs, queries, 3).collect()))
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(topk, "SHARD_DOCS", 9)
    assert sorted(map(tuple, topk.search(docs, queries, 3).collect())) == whole
    monkeypatch.setattr(topk, "SHARD_BYTES", 2000)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(topk, "SLICE_BYTES", 500)
    assert sorted(map(tuple, topk.search(docs, queries, 3).collect())) == whole


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_terms_are_those_of_a_plain_split(texts):
    import pyarrow as pa

    each, of = topk.tokens(pa.array(texts, pa.string()))
    lower = pa.compute.utf8_lower(pa.array(texts, pa.string())).to_pylist()
    want = [(i, t) for i, text in enumerate(lower) if text for t in text.translate(str.maketrans(topk.PUNCTUATION, " " * len(topk.PUNCTUATION))).split(" ") if t]
    assert list(zip(of.tolist(), each.to_pylist(), strict=True)) == want


# -- shards -------------------------------------------------------------------------------------


def check_shards(rows, limit, key):
    """Rows in the order of (key, file) are in ascending shards of the least number and even size."""
    assert [(r.range_id, r.piece) for r in rows] == sorted((r.range_id, r.piece) for r in rows)
    ranges = {}
    for r in rows:
        ranges.setdefault(r.range_id, []).append(r)
    for own in ranges.values():
        total, before = sum(r.n_bytes for r in own), 0
        n = -(-total // limit) if total > int(sharding.SLACK * limit) else 1
        for r in own:
            assert r.piece == (min(n - 1, before * n // total) if total else 0)
            before += r.n_bytes
    assert all(len({r.range_id for r in rows if key(r) == k}) == 1 for k in {key(r) for r in rows})


def test_shards_keep_order_and_size(docs):
    limit = 20_000
    rows = sorted(sharding.shard(docs, shard_bytes=limit).collect(), key=lambda r: (r.source, r.doc_id))
    assert len(rows) == docs.count()
    check_shards(rows, limit, lambda r: (r.source, r.doc_id))
    assert len({(r.range_id, r.piece) for r in rows}) > 5


def test_a_hot_key_is_cut_in_file_order(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else (None if i % 2 else f"k{i:03}"), "x" * (i % 50), "") for i in range(600)]
    spark.createDataFrame(rows, "n long, source string, text string, piece string").repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    files = {r.n: r.rid for r in table.select("n", F.monotonically_increasing_id().alias("rid")).collect()}
    found = sharding.shard(table, ("source",), shard_bytes=1000)
    rows = sorted(found.collect(), key=lambda r: (r.source is not None, r.source or "", files[r.n]))
    check_shards(rows, 1000, lambda r: r.source)
    assert len({r.piece for r in rows if r.source == "hot"}) >= 8


def test_too_many_ranges_are_an_error(docs, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_RANGES", 10)
    with pytest.raises(ValueError, match="more than 10 ranges"):
        sharding.shard(docs, shard_bytes=100)
    monkeypatch.setattr(sharding, "SHARD_BYTES", 100)
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count() and 5 <= len({(r.range_id, r.piece) for r in rows}) <= 20


def test_shards_of_hard_rows(nasty, empty):
    for limit in (1000, 1 << 26):
        found = sharding.shard(nasty, shard_bytes=limit)
        assert found.count() == nasty.count()
        assert found.columns == [*nasty.columns, "n_bytes", "range_id", "piece"]
        assert all(r.n_bytes == len((r.text or "").encode()) for r in found.collect())
    assert sharding.shard(empty).count() == 0
    clashing = nasty.withColumn("piece", F.lit("x")).withColumn("range_id", F.lit(1))
    assert sharding.shard(clashing).count() == nasty.count()


# -- licenses -----------------------------------------------------------------------------------

NOTICES = [(name, text) for name, texts in sorted(licenses.TEMPLATES.items()) for text in texts]


def contained(text):
    """License -> (containment, first word) of the best window, by looking at every window."""
    words, found = licenses.plain_words(text), {}
    runs = lambda ws: {tuple(ws[i : i + licenses.SHINGLE]) for i in range(len(ws) - licenses.SHINGLE + 1)}
    for name, notice in NOTICES:
        own = runs(licenses.plain_words(notice))
        if not own & runs(words):
            continue
        half = licenses.STRIDE << licenses.level_of(len(licenses.plain_words(notice)))
        for at in range(0, len(words), half):
            # a shingle belongs to the window in which it begins
            share = len(own & runs(words[at : at + 2 * half + licenses.SHINGLE - 1])) / len(own)
            if share >= licenses.THRESHOLD and (share, -at) > found.get(name, (0, 0))[:2]:
                found[name] = (share, -at, at + 2 * half)

    def beaten(a, b):
        same = any(2 * len(x & y) >= min(len(x), len(y)) for n, s in NOTICES if n == a for m, t in NOTICES if m == b for x, y in [(runs(licenses.plain_words(s)), runs(licenses.plain_words(t)))])
        return a != b and found[b][0] > found[a][0] and -found[b][1] < found[a][2] and -found[a][1] < found[b][2] and same

    return {name: (round(share, 4), -at) for name, (share, at, _) in found.items() if not any(beaten(name, other) for other in found)}


def as_rows(df):
    return {(r.doc_id, r.license): (r.containment, r.first_word) for r in df.collect()}


def test_scan_is_the_search_of_every_window(spark, docs):
    source, rows = random.Random(5), [(r.doc_id, r.text) for r in docs.collect()]
    for i, (_, notice) in enumerate(NOTICES):
        words = notice.split()
        for j, change in enumerate((0, 0.02, 0.05, 0.12)):  # words replaced, which takes three shingles each
            told = [f"x{source.randrange(99)}" if source.random() < change else w for w in words]
            filler = " ".join(f"w{source.randrange(9999)}" for _ in range(source.randrange(120)))
            rows.append((10_000 + 10 * i + j, f"{filler} {' '.join(told)} {filler}"))
    want = {(d, name): hit for d, text in rows for name, hit in contained(text).items()}
    found = as_rows(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(want) > 150
    same = sum(found.get(k) == v for k, v in want.items())
    assert same >= 0.99 * len(want) and set(found) <= set(want)


def test_notices_that_are_said_otherwise(spark):
    rows = [
        (1, "the code is licensed under the MIT License see below", "mit"),
        (2, licenses.TEMPLATES["gpl-3.0"][0].replace("software;", "software:").replace("; either", ", either").replace("any later", "any newer"), "gpl-3.0"),
        (3, "redistribution and use in source and binary forms with or without modification are permitted provided that the above", None),
        (4, "we talked about the license of the driver and the rights of all", None),
    ]
    found = as_rows(licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")))
    assert {(d, name) for d, _, name in rows if name} <= set(found)
    assert not {d for d, _ in found} & {3, 4}


def test_versions_are_told_apart(spark):
    lines = ["This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU General Public License version 2", licenses.TEMPLATES["agpl-3.0"][0], licenses.TEMPLATES["lgpl-2.1"][0], licenses.TEMPLATES["bsd-2-clause"][0], licenses.TEMPLATES["bsd-3-clause"][0]]
    both = " ".join([lines[0], "x " * 40, lines[1]])
    found = {}
    for d, name in as_rows(licenses.scan_licenses(spark.createDataFrame(list(enumerate([*lines, both])), "doc_id long, text string"))):
        found.setdefault(d, set()).add(name)
    assert found == {0: {"gpl-3.0"}, 1: {"gpl-2.0"}, 2: {"agpl-3.0"}, 3: {"lgpl-2.1"}, 4: {"bsd-2-clause"}, 5: {"bsd-3-clause"}, 6: {"gpl-2.0", "gpl-3.0"}}


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_notice_is_retrieved_with_high_probability(name):
    assert all(licenses.guarantee(notice) > 0.95 for notice in licenses.TEMPLATES[name])


def test_clean_text_has_no_license(spark):
    source = random.Random(0)
    rows = [(i, " ".join(f"w{source.randrange(9999)}" for _ in range(500))) for i in range(300)]
    assert licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_licenses_of_hard_rows(spark, nasty, empty):
    assert licenses.scan_licenses(nasty).count() == licenses.scan_licenses(empty).count() == 0
    notice = "Released under the MIT License."
    rows = [(1, notice), (1, notice), (None, notice), (2, f"{notice} a b c d e f g h i {notice} All rights reserved."), (3, None), (4, ""), (5, "MIT License"), (6, "x " * 100_000 + notice)]
    found = sorted(((r.doc_id, r.license, r.containment, r.first_word) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert found == [(1, "mit", 1.0, 0), (1, "mit", 1.0, 0), (2, "all-rights-reserved", 1.0, 12), (2, "mit", 1.0, 0), (6, "mit", 1.0, 99_996), (None, "mit", 1.0, 0)]


# -- the pipeline -------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, "/root/testdata/sf0.001")
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        assert 0 < kept.count() <= before.count()
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    last = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    check_packs(last, [(r.doc_id, r.text) for r in kept.collect()], packing.CONTEXT)


def through(spark, table, tmp_path, label):
    """What each stage returns, written and read again."""
    found = [table]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, found[-1], "").write.parquet(str(tmp_path / f"{label}{name}"))
        found.append(spark.read.parquet(str(tmp_path / f"{label}{name}")))
    return found[1:]


def test_pipeline_links_near_copies_whose_fingerprints_share_no_block_of_bits(spark):
    import pyarrow as pa

    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words)] + [" ".join(words[: 120 - n] + [f"x{n}y{t}z{i}" for i in range(n)]) for n in range(15, 30) for t in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)))] * 2 + [pa.array(texts)], ["rid", "doc_id", "text"])
    fp = np.frombuffer(b"".join(next(simhash._fingerprint_batches(iter([batch]))).column(2).to_pylist()), np.uint64).reshape(-1, 8)
    differ = fp[1:] ^ fp[0]
    apart = (np.bitwise_count(differ).sum(1) <= simhash.MAX_DISTANCE) & (differ.view(np.uint16) != 0).all(1)
    assert apart.sum() > 3
    for i in np.flatnonzero(apart)[:2] + 1:
        rows = spark.createDataFrame([(0, texts[0], "de"), (1, texts[i], "de"), (2, "anderes", "de")], "doc_id long, text string, lang string")
        assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()) == [0, 2]


def test_pipeline_of_an_empty_table_and_hard_rows(spark, empty, nasty, tmp_path):
    assert [t.count() for t in through(spark, empty, tmp_path, "empty")] == [0, 0, 0, 0]
    nasty.withColumn("lang", F.lit(None).cast("string")).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    languages, lines, near, packs = through(spark, table, tmp_path, "nasty")
    assert languages.count() == nasty.count()
    for kept in (languages, lines, near):
        assert kept.columns == nasty.columns
        assert {tuple(r) for r in kept.select("rid", "fp", "node", "label", "line", "owner", "kept_line_numbers", "row_number_in_files", "query", "bounds_of_ranges", "part", "pack_id").collect()} == {("x", "y", 1, None, None, 2, 3, 4, "q", 5, 6, 7)}
    rows = sorted(((r.doc_id, r.text, r.n_chars) for r in lines.collect()), key=repr)
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 7, 8, None, None]
    assert all(n == (None if text is None else len(text)) for _, text, n in rows)
    assert rows[0][1] == "eins zwei drei\nvier\n\nfünf" and rows[1][1] is None and rows[3][1] == "   \n\t\n "
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in near.collect()), key=repr) == rows
    check_packs(packs.collect(), [(d, text.replace("▁", "x") if text else text) for d, text, _ in rows], packing.CONTEXT)


def test_pipeline_against_slow_versions(spark, docs, tmp_path):
    from test_dedup import groups_of, prints_of

    from lexaxis.llm import simhash

    source = random.Random(2)
    noise = [(900_000 + i, "".join(source.choice("0123456789 #$%&|~^") for _ in range(384)), None, "s", 384) for i in range(9)]
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(noise, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    languages, lines, near, packs = (sorted(t.collect(), key=lambda r: r[0]) for t in through(spark, table, tmp_path, "slow"))
    model, want = langid.train(table), set()
    for r in table.collect():
        raw, total = (r.text or "").encode(), np.zeros(len(model.labels))
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            total += plain_network(model, np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)[None])[0] * len(part) / len(raw)
        if raw and 1 - total[-1] >= langid.MIN_CONFIDENCE:
            want.add(r.doc_id)
    assert {r.doc_id for r in languages} == want and not want & {d for d, *_ in noise[1:]}
    seen, kept = set(), {}
    for r in languages:
        own = [x for x in r.text.split("\n") if not x.strip(" ") or not (x in seen or seen.add(x))]
        if any(x.strip(" ") for x in own) or not any(x.strip(" ") for x in r.text.split("\n")):
            kept[r.doc_id] = "\n".join(own)
    assert {r.doc_id: r.text for r in lines} == kept
    at, fp = prints_of([r.text for r in lines])
    close = [(lines[at[i]].doc_id, lines[at[j]].doc_id) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]).sum(1) <= simhash.MAX_DISTANCE) + i + 1]
    drop = {x for x, root in groups_of(close).items() if x != root}
    gone = {r.doc_id for r in lines} - {r.doc_id for r in near}
    assert gone <= drop and len(gone) >= 0.9 * len(drop)
    check_packs(packs, [(r.doc_id, r.text) for r in near], packing.CONTEXT)
