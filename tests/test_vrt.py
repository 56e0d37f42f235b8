import gzip

import pytest

from lexaxis.sources import vrt
from lexaxis.sources.corpus import CorpusError
from lexaxis.sources.vrt_encode import encode_vrt, main
from lexaxis.streaming.growing import word_counts

TEXT = """<text id="t&amp;1" tags="|b|a|">
<s n="1">
Ein\tART\t1
Beispiel\tNN\t0

</s>
<s n="2">
<g/>
Noch\tADV\tx
eins\tPIS\t-1
.\t$.\t0
</s>
</text>
<text id="t2" tags="">
<s n="x">
Ein\tART\t0
</s>
</text>
"""


@pytest.fixture(params=["plain", "gz"])
def source(tmp_path, request):
    path = tmp_path / ("a.vrt" if request.param == "plain" else "a.vrt.gz")
    (path.write_text(TEXT) if request.param == "plain" else gzip.open(path, "wt").write(TEXT))
    if request.param == "gz":
        path.write_bytes(gzip.compress(TEXT.encode()))
    return str(path)


def test_readers(spark, source):
    found = vrt.events(spark, source)
    assert [(r.cpos, r.value) for r in vrt.token_column(found, 1).orderBy("cpos").collect()] == [(0, "ART"), (1, "NN"), (2, "ADV"), (3, "PIS"), (4, "$."), (5, "ART")]
    assert sorted((r.start, r.end) for r in vrt.tag_spans(found, "s").collect()) == [(0, 2), (2, 5), (5, 6)]
    assert sorted((r.start, r.value) for r in vrt.annotation(found, "text", "id").collect()) == [(0, "t&1"), (5, "t2")]
    assert {r.what: r.n for r in vrt.stats(found).collect()} == {"tokens": 6, "columns": 3, "<text>": 2, "<s>": 3}
    with pytest.raises(Exception, match="no column"):
        vrt.token_column(found, 3).collect()
    with pytest.raises(Exception, match="without nothing"):
        vrt.annotation(found, "s", "nothing").collect()


def test_wrong_nesting_is_an_error(spark, tmp_path):
    for i, text in enumerate(("<a>\n<b>\nx\n</a>\n</b>\n", "<a>\nx\n")):
        (tmp_path / f"{i}.vrt").write_text(text)
        with pytest.raises(Exception, match="not closed"):
            vrt.spans(vrt.events(spark, str(tmp_path / f"{i}.vrt"))).collect()


def test_nested_elements_of_one_name(spark, tmp_path):
    (tmp_path / "n.vrt").write_text("<a>\nx\n<a>\ny\n</a>\n</a>\n")
    found = vrt.spans(vrt.events(spark, str(tmp_path / "n.vrt")))
    assert sorted((r.depth, r.start, r.end) for r in found.collect()) == [(0, 0, 2), (1, 1, 2)]
    with pytest.raises(CorpusError, match="overlap"):
        encode_vrt(spark, str(tmp_path / "n.vrt"), str(tmp_path / "out"), ["word"], ["a"])


def test_encode(spark, source, tmp_path):
    with pytest.raises(CorpusError, match="several outermost"):
        encode_vrt(spark, source, str(tmp_path / "no"), ["word"], ["text"])
    made = encode_vrt(spark, source, str(tmp_path / "out"), ["word", "tag:indexed", "number:skip"], ["text", "s"], ["text+id", "text+tags:set", "s+n:delta"], int_default=-1, invalid_xml=True)
    assert made.layer_names == ["seg_s", "seg_text", "tokens"] and made["tokens"].variable_names == ["tag", "word"]
    assert [r.tags for r in made["seg_text"]["tags"].orderBy("seg_id").collect()] == [["a", "b"], []]
    assert [r.n for r in made["seg_s"].as_kind("n", "delta").orderBy("seg_id").collect()] == [1, 2, -1]
    assert [(r.str, r.freq) for r in made.table("lexicon_word").orderBy("id").limit(2).collect()] == [("Ein", 2), ("Beispiel", 1)]
    with pytest.raises(CorpusError, match="unknown type"):
        encode_vrt(spark, source, str(tmp_path / "no"), ["word:float"])
    with pytest.raises(CorpusError, match="there already"):
        encode_vrt(spark, source, str(tmp_path / "out"), ["word"])
    assert encode_vrt(spark, source, str(tmp_path / "out"), ["word"], force=True, uncompressed=True).layer_names == ["tokens"]
    assert not list((tmp_path / "out").glob("tokens/*snappy*"))


PARSED = """<s>
1\tDas\t3
2\tist\t3
3\tGut\t0
4\t!\t1
</s>
<s>
1\tJa\t2
2\tdoch\t0
x\t?\t1
4\t.\tx
</s>
"""


def test_pointers_count_from_a_column(spark, tmp_path):
    (tmp_path / "p.vrt").write_text(PARSED)
    heads = ["index:skip", "word", "head:ptr"]
    made = encode_vrt(spark, str(tmp_path / "p.vrt"), str(tmp_path / "p"), heads, ptr_base="index")
    assert [r.head for r in made["tokens"].as_kind("head", "ptr").orderBy("cpos").collect()] == [2, 2, 2, 0, 5, 5, None, None]
    for base, more in ((None, []), ("lemma", []), ("index", ["other:ptr"])):
        with pytest.raises(CorpusError):
            encode_vrt(spark, str(tmp_path / "p.vrt"), str(tmp_path / "no"), [*heads, *more], ptr_base=base)
    (tmp_path / "q.vrt").write_text("1\ta\t9\n")
    with pytest.raises(CorpusError, match="outside"):
        encode_vrt(spark, str(tmp_path / "q.vrt"), str(tmp_path / "q"), heads, ptr_base="index")


def test_a_root_is_put_above(spark, source):
    found = vrt.events(spark, source)
    assert sorted((r.tag, r.depth, r.start, r.end) for r in vrt.spans(found, "root").where("tag <> 's'").collect()) == [("root", 0, 0, 6), ("text", 1, 0, 5), ("text", 1, 5, 6)]
    assert sorted(r.tag for r in vrt.outermost(found).collect()) == ["text", "text"]


def test_elements_of_one_root_are_paired_by_blocks(spark, tmp_path):
    (tmp_path / "r.vrt").write_text("<root>\n" + "".join(f'<s n="{i}">\n<w>\nx\n</w>\ny\n</s>\n' for i in range(300)) + "</root>\n")
    found = vrt.spans(vrt.events(spark, str(tmp_path / "r.vrt")))
    rows = sorted((r.tag, r.start, r.end) for r in found.collect())
    assert rows == [("root", 0, 600), *(("s", 2 * i, 2 * i + 2) for i in range(300)), *sorted(("w", 2 * i, 2 * i + 1) for i in range(300))]


def test_command_line(spark, source, tmp_path, capsys):
    main([source])
    assert "tokens" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([source.replace(".vrt", "").replace(".gz", ""), "-p", "word"])
    main([source, "-o", str(tmp_path / "cli"), "-p", "word", "-s", "s", "-x"])
    assert spark.read.parquet(str(tmp_path / "cli" / "tokens")).count() == 6
    main([source, "-p", "word", "-p", "tag:skip", "-u"])
    assert spark.read.parquet(str(tmp_path / "a" / "tokens")).columns == ["cpos", "word"]
    main([source, "-f", "-p", "word"])


def test_files_hold_the_corpus_in_order(spark, tmp_path):
    from lexaxis.plans.registry import as_vrt, encoded

    made = encoded(spark, "/root/testdata/sf0.001")
    want = [r.line for r in vrt.decode(made.table("tokens"), made.table("seg_doc"), made.table("seg_line")).orderBy("cpos", "place").collect()]
    assert [r.value for r in vrt.events(spark, as_vrt(made)).orderBy("line_no").collect()] == want


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("a b a",), ("b",), (None,)], "text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = word_counts(spark.readStream.schema("text string").parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {r.word: r.freq for r in spark.table("counts").collect()} == {"a": 2, "b": 2}
