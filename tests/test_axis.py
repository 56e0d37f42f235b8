"""Invariants and edges of axes, layers and lookups."""

import pytest
from pyspark.errors import PySparkValueError
from pyspark.sql import functions as F

from lexaxis.functions.parsing import int_parse, pointer_parse, set_parse
from lexaxis.operators import concordance, lexicon, positions, postings, segments, values
from lexaxis.operators.numbering import block_of, numbered
from lexaxis.sources import axis, corpus
from lexaxis.sources.corpus import Corpus, CorpusError, DanglingBase, Layer, WrongKind, check_manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus_of(spark, *texts):
    docs = spark.createDataFrame([(i * 5000 - 7000, t, "xx", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    spans = axis.document_spans(docs)
    return spans, axis.tokens(docs, spans)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 32, 1000])
def test_positions_are_dense_and_in_order(spark, n):
    words = [f"w{i % 7}" for i in range(n)]
    spans, tokens = corpus_of(spark, None, " ".join(words[: n // 2]), "", " \n ", "\n".join(words[n // 2 :]))
    found = tokens.orderBy("cpos").collect()
    assert [r.cpos for r in found] == list(range(n))
    assert [r.word for r in found] == words
    assert [(r.start, r.end) for r in spans.orderBy("seg_id").collect()] == [x for x in [(0, n // 2), (n // 2, n)] if x[0] < x[1]]


def test_empty_table(spark):
    spans, tokens = corpus_of(spark)
    assert spans.count() == tokens.count() == lexicon.build(tokens).count() == axis.line_spans(tokens).count() == 0


def test_lexicon_ranks_by_frequency_then_first_position(spark):
    _, tokens = corpus_of(spark, "b a a c b", "d c c")
    assert [(r.str, r.freq, r.first_cpos) for r in lexicon.build(tokens).orderBy("id").collect()] == [("c", 3, 3), ("b", 2, 0), ("a", 2, 1), ("d", 1, 5)]


def test_numbers_across_blocks(spark):
    df = spark.range(-500, 500).withColumn("block", block_of(F.col("id"), 64))
    assert all(r.n == r.id + 500 for r in numbered(df, ["block"], ["id"], "n").collect())


def lex_of(spark, *words):
    return spark.createDataFrame([(i, w, 1, i) for i, w in enumerate(words)], "id long, str string, freq long, first_cpos long")


def test_regular_expressions(spark):
    lex = lex_of(spark, "ab", "abc", "b", "xaby", "AB")
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(lexicon.regex_full(lex, "ab|b")) == [0, 2]  # a top-level alternative is anchored too
    assert ids(lexicon.regex_search(lex, "ab|b")) == [0, 1, 2, 3]
    assert ids(lexicon.regex_full(lex, "ab", ignore_case=True)) == [0, 4]
    for pattern, want in (("ab", [0]), ("ab.*", [0, 1]), (".*b", [0, 2]), (".*ab.*", [0, 1, 3])):
        assert ids(lexicon.regex_full(lex, pattern)) == want
    with pytest.raises(PySparkValueError):
        lexicon.regex_search(lex, "a(")
    assert lexicon.first(lex.where("false")).count() == 0


def test_simple_expressions_reach_the_scan(spark, tmp_path):
    lex_of(spark, "ab", "abc").write.parquet(str(tmp_path / "lex"))
    lex = spark.read.parquet(str(tmp_path / "lex"))
    for pattern, shown in (("ab.*", "StringStartsWith"), (".*b", "StringEndsWith"), (".*b.*", "StringContains"), ("ab", "EqualTo")):
        assert shown in lexicon.regex_full(lex, pattern)._jdf.queryExecution().executedPlan().toString()


def test_id_lists(spark):
    lex = lex_of(spark, *"abc")
    assert [(r.rank, r.str) for r in lexicon.get_all(lex, [2, 0, 2, 9]).orderBy("rank").collect()] == [(0, "c"), (1, "a"), (2, "c")]
    assert lexicon.get_all(lex, []).count() == 0
    post = spark.createDataFrame([(0, 1), (0, 4), (1, 2), (2, 3)], "word_id long, cpos long")
    assert postings.combined(post, []).count() == 0
    assert postings.combined(post, [0, 0]).count() == 2
    assert postings.combined_multi(post, [0, 0, 2]).count() == 5
    assert [r.cpos for r in postings.sliced(post, 0, 1).collect()] == [4]
    assert postings.sliced(post, 0, 2, 2).count() == 0


def segs(spark, *spans):
    return spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(spans)], "seg_id long, start long, end long")


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_containing_segment(spark, width):
    layer = segs(spark, (0, 3), (3, 4), (6, 20))
    points = spark.range(22).select(F.col("id").alias("cpos"))
    found = {r.cpos: r.seg_id for r in segments.find_containing(points, layer, "left", width).collect()}
    assert found == {p: 0 if p < 3 else 1 if p < 4 else 2 if 6 <= p < 20 else None for p in range(22)}
    assert sorted(r.cpos for r in segments.uncovered(points, layer, width).collect()) == [4, 5, 20, 21]


def test_the_interval_join_is_no_nested_loop(spark):
    layer, points = segs(spark, (0, 3)), spark.range(9).select(F.col("id").alias("cpos"))
    assert "NestedLoop" not in segments.find_containing(points, layer)._jdf.queryExecution().executedPlan().toString()


def test_boundaries_of_one_token_segments_have_both_flags(spark):
    points = spark.range(6).select(F.col("id").alias("cpos"))
    assert {r.cpos: r.flags for r in segments.boundary_flags(points, segs(spark, (0, 3), (3, 4))).collect()} == {0: 3, 1: 1, 2: 5, 3: 7, 4: 0, 5: 0}


def test_overlaps(spark):
    assert segments.overlaps(segs(spark, (0, 3), (3, 9), (9, 9))).count() == 0
    assert segments.overlaps(segs(spark, (0, 9000), (8999, 9001))).count() == 1
    assert segments.overlaps(segs(spark, (0, 9000), (2, 3), (5000, 5001)), 64).count() == 2


def test_context_ends_with_corpus_and_segment(spark):
    _, tokens = corpus_of(spark, "a b c d e")
    hits = spark.createDataFrame([(0,), (2,), (4,)], "cpos long")
    assert [(r.left, r.hit, r.right) for r in concordance.kwic(tokens, hits, 2).orderBy("cpos").collect()] == [("", "a", "b c"), ("a b", "c", "d e"), ("c d", "e", "")]
    inside = concordance.kwic(tokens, hits, 2, within=segs(spark, (0, 2), (2, 5)))
    assert [(r.left, r.right) for r in inside.orderBy("cpos").collect()] == [("", "b"), ("", "d e"), ("c d", "")]


def test_values_that_repeat_often(spark):
    df = spark.createDataFrame([(i, -5 if i % 2 else i) for i in range(100)], "cpos long, v long")
    assert values.rows_with(df, "v", -5).count() == 50
    assert values.first_with(df, "v", -5).first().cpos == 1
    assert values.first_with(df, "v", 1).count() == 0


def test_chase_ends_at_self_null_and_never_in_cycles(spark):
    rows = [(0, 0), (1, 0), (2, 1), (3, None), (4, 3), (5, 6), (6, 5), (7, 5)] + [(i, i - 1) for i in range(8, 40)]
    rows[8] = (8, 2)
    found = {r.cpos: r.root for r in values.chase(spark.createDataFrame(rows, "cpos long, head long")).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: None, 6: None, 7: None} | {i: 0 for i in range(8, 40)}


def test_parsers(spark):
    df = spark.createDataFrame([("12",), ("-3",), ("x",), (None,), ("",), ("99999999999999999999",)], "s string")
    assert [r[0] for r in df.select(int_parse(F.col("s"), 7)).collect()] == [12, -3, 7, 7, 7, 7]
    with pytest.raises(Exception, match="not an integer"):
        df.select(int_parse(F.col("s"))).collect()
    df = spark.createDataFrame([("",), ("|",), ("|b|a|b|",), (None,), ("a",)], "s string")
    assert [r[0] for r in df.select(set_parse(F.col("s"))).collect()] == [[], [], ["a", "b"], [], ["a"]]
    df = spark.createDataFrame([(5, "0"), (5, "1"), (5, "-1"), (5, "x"), (5, None)], "cpos long, h string")
    assert [r[0] for r in df.select(pointer_parse(F.col("cpos"), F.col("h"), 0)).collect()] == [5, 6, 4, None, None]
    pointers = spark.createDataFrame([(0, 0), (1, -1), (2, 3), (3, None)], "cpos long, head long")
    assert sorted(r.cpos for r in values.out_of_range(pointers, 3).collect()) == [1, 2]


def test_manifest_checks(spark):
    schema = "layer string, base string, variable string, kind string, uuid string, n long"
    good = ("t", None, "w", "indexed", "u", 3)
    check_manifest(spark.createDataFrame([good], schema))
    for bad, error in (([good, good], CorpusError), ([good, ("t", None, "x", "int", "u", 4)], CorpusError), ([("t", None, "w", "float", "u", 3)], CorpusError), ([good, ("s", "gone", "x", "int", "v", 1)], DanglingBase)):
        with pytest.raises(error):
            check_manifest(spark.createDataFrame(bad, schema))


def test_layers(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "cpos long, word string")
    layer = Layer("t", df, None, {"word": "indexed"}, "u", 2)
    assert len(layer) == 2 and layer["word"].columns == ["cpos", "word"]
    with pytest.raises(WrongKind):
        layer.as_kind("word", "int")
    with pytest.raises(CorpusError):
        layer["none"]
    more = df.select("cpos", F.lit(1).cast("long").alias("k"))
    assert layer.add_variable("k", more, "int").variable_names == ["word", "k"]
    with pytest.raises(CorpusError):
        layer.add_variable("word", more, "int")
    with pytest.raises(CorpusError):
        layer.add_variable("k", more.limit(1), "int")


def test_opened_by_name_and_uuid(spark):
    from lexaxis.plans.registry import encoded

    made = encoded(spark, "/root/testdata/sf0.001")
    again = Corpus.open(spark, made.path)
    assert "tokens" in again and "none" not in again
    assert [again.layer(u).name for u in again.layer_uuids] == again.layer_names
    assert len(again["tokens"]) == again.table("tokens").count()
    with pytest.raises(CorpusError):
        again["none"]


def test_calls_are_logged_and_rows_counted_on_the_way(spark, caplog):
    from lexaxis.plans.observe import counted, logged

    @logged
    def some(n, step=1):
        return spark.range(0, n, step)

    with caplog.at_level("DEBUG", logger="lexaxis.queries"):
        df, seen = counted(some(10, step=2))
    assert df.count() == 5 and seen.get["rows"] == 5
    assert "some(10, step=2) -> struct<id:bigint>" in caplog.text and "Physical Plan" in caplog.text


def test_repeated_and_null_document_ids_have_places_of_their_own(spark, tmp_path):
    rows = [(1, "a b"), (1, "c\nd"), (None, "e f"), (2, "g"), (None, "h"), (7_000_000_000_000, "i"), (3, None), (-5, "j")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    spans = axis.document_spans(docs)
    tokens = axis.tokens(docs, spans)
    found = [(r.cpos, r.word, r.doc_id, r.line_no, r.pos_in_doc) for r in tokens.orderBy("cpos").collect()]
    words = [("j", -5, 0, 0), ("a", 1, 0, 0), ("b", 1, 0, 1), ("c", 1, 0, 0), ("d", 1, 1, 1), ("g", 2, 0, 0), ("i", 7_000_000_000_000, 0, 0), ("e", None, 0, 0), ("f", None, 0, 1), ("h", None, 0, 0)]
    assert found == [(i, *w) for i, w in enumerate(words)]
    assert [(r.start, r.end) for r in axis.line_spans(tokens).orderBy("seg_id").collect()] == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 9), (9, 10)]
    turns = spark.createDataFrame([(1, 0), (None, 3), (1, 1), (1, 1), (None, 4)], "conv_id long, turn int")
    assert [(r.conv_id, r.turn, r.head) for r in axis.turn_pointers(turns).orderBy("cpos").collect()] == [(1, 0, 0), (1, 1, 0), (1, 1, 1), (None, 3, 3), (None, 4, 4)]


def test_a_hit_that_is_listed_twice_gives_its_line_twice(spark):
    tokens = spark.createDataFrame([(i, w) for i, w in enumerate("a b c d".split())], "cpos long, word string")
    hits = spark.createDataFrame([(1,), (1,), (3,)], "cpos long")
    assert sorted((r.cpos, r.left, r.hit, r.right) for r in concordance.kwic(tokens, hits, 1).collect()) == [(1, "a", "b", "c"), (1, "a", "b", "c"), (3, "c", "d", "")]
    layer = spark.createDataFrame([(0, 0, 4)], "seg_id long, start long, end long")
    assert sorted((r.hit, r.text) for r in concordance.surface(tokens, hits, layer).collect()) == [(1, "a [b] c d"), (1, "a [b] c d"), (3, "a b c [d]")]


def test_expressions_and_error_codes(spark):
    lex = spark.createDataFrame([(0, "ab"), (1, "b."), (2, "xabx")], "id long, str string")
    for pattern, fast, want in (("ab", True, [0]), (".*ab.*", True, [0, 2]), ("x.*", True, [2]), ("(a|b).", False, [0, 1]), (".*", False, [0, 1, 2])):
        regex = lexicon.Regex(spark, pattern)
        assert regex.optimised == fast
        assert [r.id for r in lex.where(regex.is_match(lex.str)).orderBy("id").collect()] == want
    assert [r.id for r in lexicon.matching(lex, ".").collect()] == [1]
    assert corpus.code_of(lexicon.Regex, spark, "(") == (corpus.ErrorCode.BAD_REGEX, None)
    layer = corpus.Layer("x", lex.withColumnRenamed("id", "cpos"), None, {"str": "plain"}, "u", 3)
    assert corpus.code_of(lambda: layer["no"])[0] == corpus.ErrorCode.NOT_FOUND
    assert corpus.code_of(layer.as_kind, "str", "int")[0] == corpus.ErrorCode.WRONG_KIND
    assert corpus.code_of(layer.as_kind, "str", "plain")[0] == corpus.ErrorCode.OK


@pytest.mark.parametrize("width", [1, 3, 1024])
def test_positions_meet_tables_and_segments_by_bin(spark, width):
    layer = segs(spark, (0, 3), (3, 4), (6, 20))
    of = {p: 0 if p < 3 else 1 if p < 4 else 2 for p in range(20) if not 4 <= p < 6}
    spans = spark.createDataFrame([(0, 0, 9), (1, 2, 2), (2, 2, 7), (2, 3, 30), (3, 25, 30)], "window_id long, start long, end long")
    found = sorted(map(tuple, segments.positions_within(spans, layer, width).select("window_id", "cpos", "seg_id").collect()))
    assert found == sorted((r.window_id, p, of[p]) for r in spans.collect() for p in range(r.start, r.end) if p in of)
    points = [5, 6, 7, 7, 8, 0, 1, 2, 3, 30, 3, 19, 20, 21]
    df = spark.createDataFrame([(p,) for p in points], "cpos long").coalesce(1)
    assert sorted(p for r in segments.runs(df).collect() for p in range(r.start, r.end)) == sorted(points)
    assert sorted(map(tuple, segments.start_flags(df, layer, width).collect())) == sorted((p, p in (0, 3, 6)) for p in points)
    assert segments.runs(df.where("false")).count() == 0
    rows = [(p, f"w{p}" if p % 5 else None, p * 2) for p in [*range(4, 20), 3, 2, 2, 40]]  # not in order, one repeated, gaps
    table = spark.createDataFrame(rows, "cpos long, word string, v int").coalesce(1)
    asked = spark.createDataFrame([(i, p) for i, p in enumerate([*points, -1, -3, 2000])], "i long, cpos long")
    assert sorted(map(repr, positions.gather(table, asked, width).select("i", "cpos", "word", "v").collect())) == sorted(map(repr, asked.join(table, "cpos").select("i", "cpos", "word", "v").collect()))
    want = sorted(repr((r.window_id, *row)) for r in spans.collect() for row in rows if r.start <= row[0] < r.end)
    assert sorted(repr(tuple(r)) for r in positions.windows(table, spans, width).select("window_id", "cpos", "word", "v").collect()) == want


def test_no_position_is_shuffled_or_sorted_for_a_lookup(spark):
    tokens = spark.range(100_000).select(F.col("id").alias("cpos"), F.lit("w").alias("word"))
    layer = spark.range(2000).select(F.col("id").alias("seg_id"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 50).alias("end"))
    spans = layer.select(F.col("seg_id").alias("window_id"), "start", "end")
    found = [segments.positions_within(spans, layer), segments.start_flags(tokens, layer), positions.windows(tokens, spans), positions.gather(tokens, tokens.select("cpos")), segments.find_containing(tokens, layer), segments.uncovered(tokens, layer)]
    for df in found:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "+- Sort [" not in plan
