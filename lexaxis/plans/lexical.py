"""Queries on catalogue, lexicon, positions and postings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexaxis.functions import codec
from lexaxis.operators import lexicon, positions, postings
from lexaxis.plans.registry import query
from lexaxis.sources import corpus
from lexaxis.sources.shared import scratch

WORD, IDS = "the", [5, 17, 3, 5, 100]
_LEX = ["id", "str", "freq"]
_IDS = ", ".join(f"({i}, {v})" for i, v in enumerate(IDS))


@query("select layer, n from (select 'tokens' as layer, count(*) as n from tok union all select 'seg_doc', count(*) from seg union all select 'seg_line', count(*) from ln union all select 'doc_tags', count(*) from tags union all select 'turns', count(*) from turns union all select 'events', count(*) from ev union all select 'pages', count(*) from pg)")
def layer_len(c):
    return c.manifest.groupBy("layer").agg(F.max("n").alias("n"))


@query("""select * from (values ('doc_tags', 'seg_doc', 1::bigint), ('events', null, 2::bigint), ('pages', null, 1::bigint), ('seg_doc', 'tokens', 4::bigint),
          ('seg_line', 'tokens', 2::bigint), ('tokens', null, 4::bigint), ('turns', null, 3::bigint)) as t(layer, base, variables)""")
def catalog_layers(c):
    return c.manifest.groupBy("layer", "base").agg(F.count("variable").alias("variables"))


@query("""select layer, variable, kind from (values ('seg_doc', 'documents', 'doc_id,lang,source,n_chars'), ('turns', 'conversations', 'conv_id,turn'), ('events', 'events', 'event_type,user_id'), ('pages', 'pages', 'url')) as t(layer, tab, list),
          (select table_name, column_name as variable, case when layer_of.kind is not null then layer_of.kind when data_type = 'VARCHAR' then 'indexed' else 'int' end as kind
           from information_schema.columns left join (values ('pages', 'url', 'plain')) as layer_of(tab, col, kind) on table_name = tab and column_name = col) as c
          where tab = table_name and list_contains(string_split(list, ','), variable)
          union all select * from (values ('tokens', 'word', 'indexed'), ('tokens', 'doc_id', 'int'), ('tokens', 'line_no', 'int'), ('tokens', 'pos_in_doc', 'int'), ('seg_line', 'doc_id', 'int'), ('seg_line', 'line_no', 'int'), ('doc_tags', 'tags', 'set'), ('turns', 'head', 'ptr')) as t""")
def catalog_attributes(c):
    return c.manifest.select("layer", "variable", "kind")


@query("select * from (values ('charset', 'utf-8'), ('languages', (select string_agg(lang, ',' order by lang) from (select distinct lang from seg)))) as t(property, value)")
def catalog_properties(c):
    named = c.table("seg_doc").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return named.select(F.explode(F.array(F.struct(F.lit("charset").alias("property"), F.lit("utf-8").alias("value")), F.struct(F.lit("languages").alias("property"), F.col("langs").alias("value")))).alias("r")).select("r.*")


@query("select * from (values ('orphan', 'lost'), ('seg_more', 'lost')) as t(layer, base)")
def check_dangling_base(c):
    """The manifest with two more layers, on a base that no layer has: they are found, and no other."""
    planted = c.spark.createDataFrame([("orphan", "lost"), ("seg_more", "lost"), ("seg_kept", "tokens")], "layer string, base string")
    return corpus.dangling_bases(c.manifest.select("layer", "base").unionByName(planted))


@query("select 'seg_doc' as layer, (select count(*) from seg) as n, (select count(*) from tags) as n_variable, (select count(*) from seg) = (select count(*) from tags) as fits")
def check_variable_length(c):
    n = c.table("seg_doc").agg(F.count("*").alias("n"))
    return n.crossJoin(c.table("doc_tags").agg(F.count("*").alias("n_variable"))).select(F.lit("seg_doc").alias("layer"), "n", "n_variable", (F.col("n") == F.col("n_variable")).alias("fits"))


def _anew(spark, sf_dir):
    """A corpus of its own, so that a table is made from the documents whatever queries came before."""
    return corpus.Encoding(spark, sf_dir, scratch(spark, "build"))


@query("select id, str, freq, first_cpos from lex", plain=True)
def build_lexicon(spark, sf_dir):
    return _anew(spark, sf_dir).table("lexicon")


@query("select cpos, word_id from tok", plain=True)
def build_id_stream(spark, sf_dir):
    return _anew(spark, sf_dir).table("ids")


@query('select seg_id, "start", "end", doc_id from seg', plain=True)
def build_segmentation(spark, sf_dir):
    return _anew(spark, sf_dir).table("seg_doc").select("seg_id", "start", "end", "doc_id")


@query(f"select word_id, cpos // {postings.INDEX_BLOCK} as block, count(*) as n, string_agg(cpos, ',' order by cpos) as cpos_list from tok group by word_id, block")
def build_inverted_index(c):
    index = postings.inverted_index(c.table("postings"))
    return index.select("word_id", "block", "n", F.array_join(F.col("cpos_list").cast("array<string>"), ",").alias("cpos_list"))


@query("select count(*) as tokens, count(distinct word) as types from tok")
def type_token_counts(c):
    return c.table("lexicon").agg(F.sum("freq").alias("tokens"), F.count("*").alias("types"))


@query("select cpos, word from tok where cpos = 1234")
def token_at(c):
    return positions.at(c.table("tokens"), 1234).select("cpos", "word")


@query("select cpos, word_id from tok where cpos = 1234")
def token_id_at(c):
    return positions.at(c.table("ids"), 1234).select("cpos", "word_id")


@query("select cpos, word from tok where cpos >= 160 and cpos < 176")
def token_range(c):
    return positions.between(c.table("tokens"), 160, 176).select("cpos", "word")


@query("select cpos, word from tok")
def token_scan(c):
    return c.table("tokens").select("cpos", "word")


@query("select cpos, word, word_id, doc_id from tok where cpos >= 1000 and cpos < 5000")
def row_range(c):
    return positions.between(c.table("tokens"), 1000, 5000).join(positions.between(c.table("ids"), 1000, 5000), "cpos").select("cpos", "word", "word_id", "doc_id")


@query("select word_id from tok where cpos >= 1000")
def column_range(c):
    return positions.between(c.table("ids"), 1000).select("word_id")


@query(f"select id, str, freq from lex where str = '{WORD}'")
def lex_exact(c):
    return lexicon.exact(c.table("lexicon"), WORD).select(*_LEX)


@query("select id, str, freq from lex where regexp_matches(str, '(io|un)g')")
def lex_regex_search(c):
    return lexicon.regex_search(c.table("lexicon"), "(io|un)g").select(*_LEX)


@query("select id, str, freq from lex where regexp_matches(str, '^..ing$') order by id limit 1")
def lex_regex_first(c):
    return lexicon.first(lexicon.regex_search(c.table("lexicon"), "^..ing$")).select(*_LEX)


@query("select id, str, freq from lex where regexp_full_match(str, '.+(ung|heit|keit)')")
def lex_regex_full(c):
    return lexicon.regex_full(c.table("lexicon"), ".+(ung|heit|keit)").select(*_LEX)


@query("select id, str, freq from lex where regexp_full_match(str, 'th(e|at|is)', 'i')")
def lex_regex_icase(c):
    return lexicon.regex_full(c.table("lexicon"), "th(e|at|is)", ignore_case=True).select(*_LEX)


@query("select id, str, freq from lex where starts_with(str, 'th')")
def lex_prefix(c):
    return lexicon.prefix(c.table("lexicon"), "th").select(*_LEX)


@query("select id, str, freq from lex where ends_with(str, 'tion')")
def lex_suffix(c):
    return lexicon.suffix(c.table("lexicon"), "tion").select(*_LEX)


@query("select id, str, freq from lex where contains(str, 'sti')")
def lex_contains(c):
    return lexicon.contains(c.table("lexicon"), "sti").select(*_LEX)


@query("select id, str, freq from lex where strlen(str) = 3 and upper(str) = str and lower(str) <> str")
def lex_predicate(c):
    """A predicate that is no string: three bytes, all of them capitals where they have a case."""
    return lexicon.matching(c.table("lexicon"), lambda s: (F.octet_length(s) == 3) & (F.upper(s) == s) & (F.lower(s) != s)).select(*_LEX)


@query("select 'contains' as way, count(*) as types, cast(sum(freq) as bigint) as tokens from lex where contains(str, 'sti') union all select 'prefix', count(*), cast(sum(freq) as bigint) from lex where starts_with(str, 'th')")
def lex_string_and_regex(c):
    """Prefix and containment by string and by expression: a row for each way, if both say the same."""
    lex = c.table("lexicon")
    rows = [(way, by_string, lexicon.regex_search(lex, pattern)) for way, by_string, pattern in (("contains", lexicon.contains(lex, "sti"), "sti"), ("prefix", lexicon.prefix(lex, "th"), "^th"))]
    sums = lambda way, df: df.agg(F.lit(way).alias("way"), F.count("*").alias("types"), F.sum("freq").alias("tokens"))
    one, two = (sums(way, a).join(sums(way, b), ["way", "types", "tokens"]) for way, a, b in rows)
    return one.unionByName(two)


@query("select a.id, a.str from lex a where a.id % 7 = 3 and a.freq > 1")
def lex_by_hash(c):
    """Strings looked up by their hash, then compared: as an index of hashes does it."""
    lex = c.table("lexicon")
    wanted = lex.where("id % 7 = 3 and freq > 1").select(F.xxhash64("str").alias("hash"), F.col("str").alias("wanted"))
    return lex.select("id", "str", F.xxhash64("str").alias("hash")).join(wanted, "hash").where("str = wanted").select("id", "str")


@query("select id, str, freq from lex where id = 42")
def lex_get(c):
    return lexicon.get(c.table("lexicon"), 42).select(*_LEX)


@query(f"select rank::bigint as rank, id, str from lex join (values {_IDS}) as w(rank, id) using (id)")
def lex_get_all(c):
    return lexicon.get_all(c.table("lexicon"), IDS)


@query("select id, str, freq from lex")
def lex_scan(c):
    return c.table("lexicon").select(*_LEX)


@query("select word_id, count(*) as freq from tok group by word_id")
def type_frequency(c):
    return postings.frequencies(c.table("postings"))


@query("select cpos from tok where word_id = 7")
def postings_of_type(c):
    return postings.of_type(c.table("postings"), 7)


@query("select word_id, cpos from tok where word_id in (5, 17, 3, 100)")
def postings_combined(c):
    return postings.combined(c.table("postings"), IDS)


@query(f"select word_id, cpos from tok join (values {_IDS}) as w(rank, id) on id = word_id")
def postings_combined_multi(c):
    return postings.combined_multi(c.table("postings"), IDS)


@query("select nth, cpos from (select cpos, row_number() over (order by cpos) - 1 as nth from tok where word_id = 7) where nth >= 10 and nth < 30")
def postings_slice(c):
    return postings.sliced(c.table("postings"), 7, 10, 30)


@query("select word_id, cpos, nth from (select word_id, cpos, row_number() over (partition by word_id order by cpos) - 1 as nth from tok) where nth = 5")
def postings_nth(c):
    return postings.ranked(c.table("postings")).where("nth = 5")


@query("select id as word_id, cpos from t0 join lex on str = word where freq between 5 and 50")
def typelist_postings(c):
    return postings.of_types(c.table("postings"), c.table("lexicon").where("freq between 5 and 50"))


@query("select id, str from lex")
def cl_id2str(c):
    return c.table("lexicon").select("id", "str")


@query("select id, cast(strlen(str) as integer) as bytes from lex")
def cl_id2strlen(c):
    return c.table("lexicon").select("id", F.octet_length("str").alias("bytes"))


@query("select id, str, row_number() over (order by str) - 1 as sort from lex")
def cl_id2sort(c):
    return lexicon.sort_ranks(c.table("lexicon"))


@query("select row_number() over (order by str) - 1 as sort, id from lex")
def cl_sort2id(c):
    """The type at each place in byte order."""
    return lexicon.sort_ranks(c.table("lexicon")).select("sort", "id")


@query("select id, str, cast(strlen(str) as integer) as bytes, freq from lex")
def cl_id2all(c):
    return c.table("lexicon").select("id", "str", F.octet_length("str").alias("bytes"), "freq")


@query("select cast(coalesce(sum(freq), 0) as bigint) as freq from lex where id in (5, 17, 3, 100)")
def cl_idlist2freq(c):
    return c.table("lexicon").where(F.col("id").isin(*IDS)).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("freq"))


@query("""
    , fb as materialized (select id, str, hex(encode(str)) as h from lex),
    fh as (with recursive step(id, str, h, i, x) as (
              select id, str, h, 0, 14695981039346656037::hugeint from fb
              union all
              select id, str, h, i + 1, (xor(x, ('0x' || substr(h, 2 * i + 1, 2))::integer::hugeint) * 1099511628211::hugeint) % 18446744073709551616::hugeint from step where 2 * i < length(h))
           select id, str, x from step where 2 * i = length(h))
    select id, str, cast(case when x >= 9223372036854775808::hugeint then x - 18446744073709551616::hugeint else x end as bigint) as hash from fh""")
def fnv_hash(c):
    """FNV-1a of every type, in 64 bits that wrap."""
    return c.table("lexicon").select("id", "str", codec.fnv_hash("str").alias("hash"))


@query("""select id, freq, case when freq < 64 then 1 when freq < 8192 then 2 when freq < 1048576 then 3 else 4 end as bytes,
          case when first_cpos < 64 then 1 when first_cpos < 8192 then 2 when first_cpos < 1048576 then 3 when first_cpos < 134217728 then 4 else 5 end as bytes_negative from lex""")
def varint_length(c):
    return c.table("lexicon").select("id", "freq", codec.varint_length(F.col("freq")).alias("bytes"), codec.varint_length(-F.col("first_cpos") - 1).alias("bytes_negative"))


@query("select id, first_cpos as value, first_cpos as decoded from lex")
def varint_roundtrip(c):
    return c.table("lexicon").select("id", F.col("first_cpos").alias("value"), codec.varint_decode(codec.varint_encode("first_cpos")).alias("decoded"))


@query(f"select word_id, cpos // {postings.INDEX_BLOCK} as block, string_agg(cpos, ',' order by cpos) as decoded from tok group by word_id, block")
def varint_blocks(c):
    packed = postings.inverted_index(c.table("postings")).select("word_id", "block", codec.varint_encode_block(codec.delta(F.col("cpos_list"))).alias("raw"))
    rows = packed.select("word_id", "block", F.posexplode(codec.varint_decode_block("raw")).alias("i", "gap"))
    decoded = rows.withColumn("cpos", F.sum("gap").over(Window.partitionBy("word_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return decoded.groupBy("word_id", "block").agg(F.array_join(F.sort_array(F.collect_list("cpos")).cast("array<string>"), ",").alias("decoded"))


@query("select cpos // 16 as block, count(*) as n, min(cpos) as first, sum(word_id)::bigint as ids from tok group by block")
def index_blocks(c):
    """What a block of BLOCK_ROWS rows holds: its number, rows, first position and sum of ids."""
    rows = positions.batched(c.table("ids").select("cpos", "word_id"), codec.BLOCK_ROWS)
    return rows.groupBy(F.col("batch").alias("block")).agg(F.count("*").alias("n"), F.min("cpos").alias("first"), F.sum("word_id").alias("ids"))


@query("select cpos, word_id - coalesce(lag(word_id) over (partition by cpos // 16 order by cpos), 0) as gap from tok")
def delta_encode(c):
    return c.table("ids").select("cpos", codec.delta_encode(F.col("word_id"), F.expr(f"cpos div {codec.BLOCK_ROWS}"), F.col("cpos")).alias("gap"))


@query("select cpos, word_id as value from tok")
def delta_decode(c):
    block = F.expr(f"cpos div {codec.BLOCK_ROWS}")
    gaps = c.table("ids").select("cpos", codec.delta_encode(F.col("word_id"), block, F.col("cpos")).alias("gap"))
    return gaps.select("cpos", codec.delta_decode(F.col("gap"), block, F.col("cpos")).alias("value"))


@query("select cpos, cpos // 16 as block, cpos % 16 as place from tok")
def block_address(c):
    return c.table("tokens").select("cpos", F.expr(f"cpos div {codec.BLOCK_ROWS}").alias("block"), (F.col("cpos") % codec.BLOCK_ROWS).alias("place"))


@query("""select (select count(*) from tok) as tokens, (select cast(sum(strlen(str) + 1) as bigint) from lex) as lexicon_bytes,
          (select cast(sum(case when word_id < 64 then 1 when word_id < 8192 then 2 when word_id < 1048576 then 3 else 4 end) as bigint) from tok) as stream_bytes""")
def storage_estimate(c):
    lex = c.table("lexicon")
    return lex.agg(F.sum("freq").alias("tokens"), F.sum(F.octet_length("str") + 1).alias("lexicon_bytes"), F.sum(F.col("freq") * codec.varint_length(F.col("id"))).alias("stream_bytes"))
