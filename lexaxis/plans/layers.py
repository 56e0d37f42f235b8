"""Queries on segments and on integer, plain, set and pointer variables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexaxis.functions.parsing import int_parse, pointer_from, pointer_parse, set_parse
from lexaxis.operators import positions, segments, values
from lexaxis.plans.registry import query
from lexaxis.sources import axis

_SEG = ["seg_id", "start", "end"]


@query('select seg_id, "start", "end" from ln where seg_id = 17')
def seg_get(c):
    return c.table("seg_line").where("seg_id = 17").select(*_SEG)


@query('select seg_id, "start", "end", doc_id, line_no::integer as line_no from ln')
def seg_scan(c):
    return c.table("seg_line").select(*_SEG, "doc_id", "line_no")


@query("select cpos, seg_id from t0 join ln using (doc_id, line_no)")
def seg_find_containing(c):
    return segments.positions_within(segments.runs(c.table("tokens").select("cpos")), c.table("seg_line").select(*_SEG)).select("cpos", "seg_id")


@query('select seg.seg_id as doc_seg from seg join ln on seg."start" = ln."start" and seg."end" = ln."end"')
def seg_contains(c):
    return segments.contains(c.table("seg_doc").select(F.col("seg_id").alias("doc_seg"), "start", "end"), c.table("seg_line")).select("doc_seg")


@query('select cpos from tok where word = \'The\' and cpos in (select "start" from ln)')
def seg_contains_start(c):
    return segments.contains_start(c.table("tokens").where("word = 'The'").select("cpos"), c.table("seg_line"))


@query('select cpos from tok where word = \'The\' and cpos in (select "end" from ln)')
def seg_contains_end(c):
    return segments.contains_end(c.table("tokens").where("word = 'The'").select("cpos"), c.table("seg_line"))


@query("select cpos from tok where line_no >= 2")
def seg_uncovered(c):
    """Positions outside the first two lines of the documents."""
    return segments.uncovered(c.table("tokens").select("cpos"), c.table("seg_line").where("line_no < 2"))


@query("""select 1000000000 + seg_id as seg_id, seg_id as other from ln where "end" - "start" > 40""")
def seg_overlaps(c):
    """The line layer with each long line's second half once more: each such half overlaps its line, and nothing else does."""
    lines = c.table("seg_line").select(*_SEG)
    halves = lines.where(F.col("end") - F.col("start") > 40).select((F.col("seg_id") + 1_000_000_000).alias("seg_id"), F.expr("(start + end) div 2").alias("start"), "end")
    return segments.overlaps(lines.unionByName(halves))


@query('select cpos, cpos in (select "start" from ln) as at_start from tok')
def seg_start_flags(c):
    return segments.start_flags(c.table("tokens").select("cpos"), c.table("seg_line"))


@query('select cpos, cast(1 + case when cpos = "start" then 2 else 0 end + case when cpos = "end" - 1 then 4 else 0 end as integer) as flags from tok join ln on tok.doc_id = ln.doc_id and tok.line_no = ln.line_no')
def cl_boundary(c):
    return segments.boundary_flags(c.table("tokens").select("cpos"), c.table("seg_line"))


@query("select cpos, lang, source from tok join seg using (doc_id) where word_id = 11")
def cl_cpos2struc2str(c):
    hits = c.table("postings").where("word_id = 11").select("cpos")
    return segments.find_containing(hits, c.table("seg_doc").select("start", "end", "lang", "source")).select("cpos", "lang", "source")


@query("select cpos, user_id from ev where cpos = 77")
def int_at(c):
    return positions.at(c.table("events"), 77).select("cpos", "user_id")


@query("select cpos, user_id from ev")
def int_scan(c):
    return c.table("events").select("cpos", "user_id")


@query("select cpos from ev where user_id = 13")
def int_get_all(c):
    return values.rows_with(c.table("events"), "user_id", 13)


@query("select user_id, count(*) as n from ev group by user_id")
def int_value_count(c):
    return values.value_counts(c.table("events"), "user_id")


@query("select cpos, user_id from ev order by user_id, cpos")
def int_sort(c):
    return c.table("events").select("cpos", "user_id").orderBy("user_id", "cpos")


@query("select cpos from ev where event_type = 'error'")
def index_get_all(c):
    return values.rows_with(c.table("events"), "event_type", "error")


@query("select min(cpos) as cpos from ev where event_type = 'error'")
def index_get_first(c):
    return values.first_with(c.table("events"), "event_type", "error")


@query("select k as \"key\", k in (select event_type from ev) as found from (values ('error'), ('nothing')) as t(k)")
def index_contains(c):
    keys = c.spark.createDataFrame([("error",), ("nothing",)], "key string")
    held = c.table("events").select(F.col("event_type").alias("key")).distinct().withColumn("hit", F.lit(True))
    return keys.join(held, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"))


@query("select cpos, url from pg where cpos = 5")
def plain_at(c):
    return positions.at(c.table("pages"), 5).select("cpos", "url")


@query("select cpos, url from pg")
def plain_scan(c):
    return c.table("pages").select("cpos", "url")


@query("select cpos from pg where url = (select url from pg where cpos = 5)")
def plain_lookup(c):
    wanted = positions.at(c.table("pages"), 5).select("url")
    return c.table("pages").join(wanted, "url", "left_semi").select("cpos")


@query("select seg_id, array_to_string(tags, '|') as tags from tags where seg_id = 3")
def set_at(c):
    return c.table("doc_tags").where("seg_id = 3").select("seg_id", F.array_join("tags", "|").alias("tags"))


@query("select row_number() over (order by freq desc, first_cpos, str) - 1 as id, str, freq, first_cpos from (select str, count(*) as freq, min(seg_id) as first_cpos from (select seg_id, unnest(tags) as str from tags) group by str)")
def set_lexicon(c):
    return values.set_lexicon(c.table("doc_tags"), "tags")


@query("select seg_id from tags where list_contains(tags, 'q1')")
def set_members(c):
    return values.set_members(c.table("doc_tags"), "tags", "q1").select("seg_id")


@query("select doc_id, array_to_string(list_sort(list_distinct(string_split(source || '|' || lang || '|' || source, '|'))), '|') as members from documents", plain=True)
def set_parse_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.concat(F.lit(" |"), "source", F.lit("||"), "lang", F.lit("|"), "source", F.lit("| "))
    return docs.select("doc_id", F.array_join(set_parse(raw), "|").alias("members"))


@query("select cpos, coalesce(case when regexp_full_match(word, '[+-]?[0-9]+') then try_cast(word as bigint) end, -1) as value from tok")
def int_parse_default(c):
    return c.table("tokens").select("cpos", int_parse(F.col("word"), -1).alias("value"))


@query("select cpos, case when turn = 0 then cpos else cpos - 1 end as head from turns")
def ptr_encode(c):
    """Relative heads, counted from 1 at the conversation's start, made absolute; the first turn has 0."""
    rows = c.table("turns")
    start = F.col("cpos") - F.col("turn")
    return rows.select("cpos", pointer_parse(F.col("cpos"), F.col("turn").cast("string"), 1, start).alias("head"))


@query("select cpos, cpos - conv_id % 7 * 10 as head from turns where cpos - conv_id % 7 * 10 < 0")
def ptr_range_check(c):
    """Heads put back by up to 60 positions: those that leave the layer are found."""
    moved = c.table("turns").select("cpos", (F.col("cpos") - F.col("conv_id") % 7 * 10).alias("head"))
    return values.out_of_range(moved, c.size("turns")).select("cpos", "head")


@query("select cpos, case when turn = 0 then cpos else cpos + (turn - (turn + 1)) end as head from turns")
def ptr_from_column(c):
    """Heads made absolute by a base that varies by row: the turn's own number, counted from 1."""
    rows = c.table("turns")
    return rows.select("cpos", pointer_from(F.col("cpos"), F.col("turn").cast("string"), (F.col("turn") + 1).cast("string")).alias("head"))


@query("select cpos, head from turns where cpos = 9")
def ptr_head(c):
    return values.heads(c.table("turns"), 9)


@query("select cpos from turns where head = 8")
def ptr_tails(c):
    return values.tails(c.table("turns"), 8)


@query("select cpos, min(cpos) over (partition by conv_id) as root from turns")
def ptr_chase(c):
    return values.chase(c.table("turns"))


@query("select t.cpos, t.role, h.role as head_role from (select row_number() over (order by conv_id, turn) - 1 as cpos, role from conversations) t join turns using (cpos) join (select row_number() over (order by conv_id, turn) - 1 as cpos, role from conversations) h on h.cpos = head", plain=True)
def ptr_dependency(spark, sf_dir):
    """Each turn's role with that of the turn it points at."""
    from lexaxis.plans.registry import encoded

    rows = axis.row_axis(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role"), "conv_id", "turn").select("cpos", "role")
    heads = encoded(spark, sf_dir).table("turns").select("cpos", "head")
    return rows.join(heads, "cpos").join(rows.select(F.col("cpos").alias("head"), F.col("role").alias("head_role")), "head").select("cpos", "role", "head_role")
