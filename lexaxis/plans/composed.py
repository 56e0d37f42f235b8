"""Concordances, access patterns and VRT."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexaxis.operators import concordance, lexicon, positions, postings, segments
from lexaxis.plans.registry import as_vrt, encoded, query
from lexaxis.sources import vrt

#: Regular expressions that match as a whole; the same text means the same in Spark and in the oracle.
SUITE = [
    "an.+", "(der|die|das)", ".+able", ".+(heit|ness|tion)s?", ".*io.*", ".+(ung|heit|keit)", r"\p{Lu}.*", ".*[äöü].*", "the(re|n)?", "[0-9]+",
    ".*(er.+er|en.+en).*", ".*tion[.,]", "c.t", "harbou?r", "(sing|sang|sung)", ".*(st){2,}.*", "[aeiou]{3,}", r"\p{Lu}{2,4}", "(.*heit|.*heiten)", ".*é.+", "[^aeiouy]+[.,;]?", "(un|in|im).+(able|ible)",
]
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_RE = ".+(ung|heit|keit)"


@query("""select h.word, doc_id, lang, source, n_tokens, text from (select str as word, first_cpos from lex where freq = 1 order by first_cpos limit 1) h join tok on cpos = first_cpos
          join seg using (doc_id) join (select doc_id, count(*) as n_tokens, string_agg(word, ' ' order by cpos) as text from tok group by doc_id) using (doc_id)""")
def flagship_doc_lookup(c):
    """The first word that occurs once: its position, its document, and the document's text."""
    rare = lexicon.first(c.table("lexicon").where("freq = 1")).select(F.col("str").alias("word"), F.col("id").alias("word_id"))
    hit = c.table("postings").join(F.broadcast(rare), "word_id")  # one row
    placed = segments.find_containing(hit.select("word", "cpos"), c.table("seg_doc").select("seg_id", "start", "end", "doc_id", "lang", "source"))
    span = placed.select("start", "end").first()  # one row, by which the scan of the tokens is pruned
    tokens = positions.between(c.table("tokens"), *(span or (0, 0)))
    return concordance.text_of(tokens, placed).select("word", "doc_id", "lang", "source", "n_tokens", "text")


@query("select ln.seg_id, cpos, word from ln join tok using (doc_id, line_no) where ln.seg_id in (select l.seg_id from tok t join ln l using (doc_id, line_no) where t.word_id = 30)")
def seg_join_tokens(c):
    hits = postings.of_type(c.table("postings"), 30)
    return segments.join_tokens(hits, c.table("seg_line"), c.table("tokens"))


@query(f"select cpos from tok where regexp_full_match(word, '{_RE}')")
def concordance_regex(c):
    """By the lexicon: the expression is tested once a type."""
    types = lexicon.regex_full(c.table("lexicon"), _RE)
    return postings.of_types(c.table("postings"), types).select("cpos")


@query("select h.cpos, coalesce(string_agg(t.word, ' ' order by t.cpos) filter (t.cpos < h.cpos), '') as \"left\", h.word as hit, coalesce(string_agg(t.word, ' ' order by t.cpos) filter (t.cpos > h.cpos), '') as \"right\" from tok h join (values " + ", ".join(f"({i})" for i in range(-5, 6)) + ") as o(d) on true join tok t on t.cpos = h.cpos + d where regexp_full_match(h.word, 'the(re|n)?') group by h.cpos, h.word")
def kwic(c):
    types = lexicon.regex_full(c.table("lexicon"), "the(re|n)?")
    return concordance.kwic(c.table("tokens"), postings.of_types(c.table("postings"), types).select("cpos"))


@query("select h.cpos, coalesce(string_agg(t.word, ' ' order by t.cpos) filter (t.cpos < h.cpos), '') as \"left\", h.word as hit, coalesce(string_agg(t.word, ' ' order by t.cpos) filter (t.cpos > h.cpos), '') as \"right\" from tok h join (values " + ", ".join(f"({i})" for i in range(-3, 4)) + ") as o(d) on true join tok t on t.cpos = h.cpos + d and t.doc_id = h.doc_id and t.line_no = h.line_no where h.word_id = 25 group by h.cpos, h.word")
def kwic_within_lines(c):
    return concordance.kwic(c.table("tokens"), postings.of_type(c.table("postings"), 25), 3, within=c.table("seg_line"))


@query("select cpos, word from (select cpos, word, lag(word) over (order by cpos) as before from t0) where before = 'the' and starts_with(word, 's')")
def bigram_filter(c):
    return concordance.followers(c.table("tokens"), "the", "s")


@query("select h.cpos as hit, ln.seg_id, string_agg(case when t.cpos = h.cpos then '[' || t.word || ']' else t.word end, ' ' order by t.cpos) as text from tok h join ln on h.doc_id = ln.doc_id and h.line_no = ln.line_no join tok t on t.doc_id = ln.doc_id and t.line_no = ln.line_no where h.word_id = 40 group by h.cpos, ln.seg_id")
def sentence_surface(c):
    return concordance.surface(c.table("tokens"), postings.of_type(c.table("postings"), 40), c.table("seg_line"))


@query("select cpos from tok where word = 'and'")
def layer_scan_eq(c):
    return c.table("tokens").where("word = 'and'").select("cpos")


@query(f"select cpos from tok where regexp_full_match(word, '{_RE}')")
def layer_scan_regex(c):
    """By the tokens: the expression is tested on every one."""
    return c.table("tokens").where(lexicon.full_match(c.spark, F.col("word"), _RE)).select("cpos")


@query("select id, str, freq from lex where regexp_full_match(str, '.*[äöü].*')")
def freq_list_regex(c):
    return lexicon.regex_full(c.table("lexicon"), ".*[äöü].*").select("id", "str", "freq")


@query(" union all ".join(f"select {_quoted(p)} as pattern, count(*) as types, cast(coalesce(sum(freq), 0) as bigint) as tokens from lex where regexp_full_match(str, {_quoted(p)})" for p in SUITE))
def regex_suite(c):
    """Types and tokens of every expression, in one scan of the lexicon."""
    lex = c.table("lexicon")
    tests = F.array(*(F.struct(F.lit(p).alias("pattern"), lexicon.full_match(c.spark, F.col("str"), p).alias("hit")) for p in SUITE))
    each = lex.select("freq", F.explode(tests).alias("t")).groupBy("t.pattern")
    return each.agg(F.count_if("t.hit").alias("types"), F.coalesce(F.sum(F.when(F.col("t.hit"), F.col("freq"))), F.lit(0)).alias("tokens"))


#: A prime: multiples of it visit every position of a corpus whose length it doesn't divide, in scattered order.
_STEP = 7919
_SCATTERED = f"(i * {_STEP} + 13) % (select count(*) from tok)"


def _keys(c):
    """As many keys as there are positions, scattered over them: each position once, unless _STEP divides their number."""
    n = c.size("tokens")
    return c.spark.range(n).select(F.col("id").alias("i"), ((F.col("id") * _STEP + 13) % n).alias("cpos"))


@query(f"select i, k.cpos, word from (select i, {_SCATTERED} as cpos from range((select count(*) from tok)) as r(i)) k join t0 using (cpos)")
def access_random(c):
    return positions.gather_packed(c.words(), _keys(c)).select("i", "cpos", "word")


_WINDOWS = 'select i as window_id, (i * 7919 + 13) % n as "start", least(n, (i * 7919 + 13) % n + 20 + (i * 31) % 30) as "end" from (select count(*) as n from tok), range((select count(*) // 35 from tok)) as r(i)'


def _windows(c):
    n = c.size("tokens")
    start = (F.col("id") * 7919 + 13) % n
    return c.spark.range(n // 35).select(F.col("id").alias("window_id"), start.alias("start"), F.least(F.lit(n), start + 20 + (F.col("id") * 31) % 30).alias("end"))


@query(f'select window_id, cpos, word from ({_WINDOWS}) w join tok on cpos >= w."start" and cpos < w."end"')
def access_windows(c):
    return positions.windows_packed(c.words(), _windows(c)).select("window_id", "cpos", "word")


@query(f'select window_id, first, last, words from (select window_id, min(cpos) as first, max(cpos) as last, string_agg(word, \' \' order by least(cpos - w."start", w."end" - 1 - cpos), cpos) as words from ({_WINDOWS}) w join tok on cpos >= w."start" and cpos < w."end" group by window_id)')
def access_alternating(c):
    """The windows read from both ends towards the middle."""
    spans = _windows(c)
    rows = positions.windows_packed(c.words(), spans).join(spans, "window_id")
    inward = F.least(F.col("cpos") - F.col("start"), F.col("end") - 1 - F.col("cpos"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(inward.alias("d"), "cpos", "word"))), lambda x: x.word), " ")
    return rows.groupBy("window_id").agg(F.min("cpos").alias("first"), F.max("cpos").alias("last"), ordered.alias("words"))


@query("select i, d, h.cpos, word from (select i, d, (i * 7919 + 13) % n + d as cpos from (select count(*) as n from tok), range((select count(*) // 7 from tok)) as r(i), (values (-50), (-10), (-3), (0), (1), (7), (42)) as o(d)) h join tok using (cpos)")
def access_local_jumps(c):
    n = c.size("tokens")
    heads = c.spark.range(n // 7).select(F.col("id").alias("i"), F.explode(F.array(*map(F.lit, (-50, -10, -3, 0, 1, 7, 42)))).alias("d"), ((F.col("id") * 7919 + 13) % n).alias("head"))
    return positions.gather_packed(c.words(), heads.select("i", "d", (F.col("head") + F.col("d")).alias("cpos"))).select("i", "d", "cpos", "word")


@query('select cpos // 35 as window_id, cpos, word from t0')
def access_windows_sequential(c):
    """Windows of 35 positions end to end over the whole corpus."""
    n = c.size("tokens")
    start = F.col("id") * 35
    spans = c.spark.range(-(-n // 35)).select(F.col("id").alias("window_id"), start.alias("start"), F.least(F.lit(n), start + 35).alias("end"))
    return positions.windows_packed(c.words(), spans).select("window_id", "cpos", "word")


@query(f'select i, cpos, ln.seg_id from (select i, {_SCATTERED} as cpos from range((select count(*) from tok)) as r(i)) k join t0 using (cpos) join ln using (doc_id, line_no)')
def access_segment_lookup(c):
    return segments.find_containing(_keys(c), c.table("seg_line").select("seg_id", "start", "end")).select("i", "cpos", "seg_id")


@query(f'select window_id, cpos, ln.seg_id from (select window_id, unnest(range("start", "end")) as cpos from ({_WINDOWS}) w) p join t0 using (cpos) join ln using (doc_id, line_no)')
def access_segment_lookup_windows(c):
    """The segment of every position of every window."""
    return segments.positions_within(_windows(c), c.table("seg_line").select("seg_id", "start", "end")).select("window_id", "cpos", "seg_id")


@query(f'select i, seg_id, "start", "end" from (select i, (i * {_STEP} + 13) % (select count(*) from ln) as seg_id from range((select count(*) from ln)) as r(i)) join ln using (seg_id)')
def seg_random(c):
    """Segments by number in scattered order."""
    n = c.size("seg_line")
    keys = c.spark.range(n).select(F.col("id").alias("i"), ((F.col("id") * _STEP + 13) % n).alias("seg_id"))
    return keys.join(c.table("seg_line").select("seg_id", "start", "end"), "seg_id").select("i", "seg_id", "start", "end")


#: Lists of types by frequency: the ten most frequent, a list of words, and three bands.
_BANDS = {
    "top": "id < 10",
    "mixed": "str in ('the', 'end', 'und', 'near', 'Haus', 'will', 'la', 'and', 'river', 'every', 'nothere')",
    "often": "freq > 500",
    "middle": "freq between 51 and 500",
    "seldom": "freq between 5 and 50",
}


@query(" union all ".join(f"select '{band}' as band, cpos, word_id from tok where word_id in (select id from lex where {test})" for band, test in _BANDS.items()))
def access_postings_bands(c):
    """The positions of each list's types, merged: one pass over the postings for all lists."""
    lists = F.array(*(F.when(F.expr(test), F.lit(band)) for band, test in _BANDS.items()))
    types = c.table("lexicon").select(F.col("id").alias("word_id"), F.explode(F.array_compact(lists)).alias("band"))
    return c.table("postings").join(types, "word_id").select("band", "cpos", "word_id")


@query("select word_id, count(*) as n, cast(sum(pos_in_doc) as bigint) as places from tok where word_id in (select id from lex where freq between 5 and 50) group by word_id")
def access_postings_gather(c):
    """For each type of a frequency band: its positions, and what another variable has there."""
    hits = postings.of_types(c.table("postings"), c.table("lexicon").where("freq between 5 and 50"))
    return positions.gather(c.table("tokens").select("cpos", "pos_in_doc"), hits).groupBy("word_id").agg(F.count("*").alias("n"), F.sum("pos_in_doc").alias("places"))


@query("select cpos, place, line from vr")
def decode_vrt(c):
    return vrt.decode(c.table("tokens"), c.table("seg_doc"), c.table("seg_line"))


def _events(c):
    return vrt.events(c.spark, as_vrt(c))


@query("select row_number() over (order by cpos, place) - 1 as line_no, kind, tag, cast(sum((kind = 'token')::integer) over (order by cpos, place rows unbounded preceding) - (kind = 'token')::integer as bigint) as cpos, line as value from vr")
def vrt_events(c):
    return _events(c).drop("depth")


@query('select \'text\' as tag, 0 as depth, "start", "end", cast(doc_id as varchar) as name from seg union all select \'s\', 1, "start", "end", cast(line_no as varchar) from ln')
def xml_spans(c):
    return vrt.spans(_events(c)).select("tag", "depth", "start", "end", F.coalesce(F.col("attrs")["id"], F.col("attrs")["n"]).alias("name"))


@query("select cpos, cast(pos_in_doc as varchar) as value from tok")
def p_column(c):
    return vrt.token_column(_events(c), 1)


@query('select "start", "end" from ln')
def s_spans(c):
    return vrt.tag_spans(_events(c), "s").select("start", "end")


@query('select "start", "end", lang as value from seg')
def a_values(c):
    return vrt.annotation(_events(c), "text", "lang")


@query("select 'tokens' as what, count(*) as n from tok union all select 'columns', 2 union all select '<text>', count(*) from seg union all select '<s>', count(*) from ln")
def vrt_stats(c):
    return vrt.stats(_events(c))


@query("select word, count(*) as freq from (select unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) as word from documents) where word <> '' group by word", plain=True)
def stream_word_counts(spark, sf_dir):
    """The streaming aggregate, run over the table as one batch."""
    from lexaxis.streaming.growing import word_counts

    return word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
