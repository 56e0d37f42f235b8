"""Vertical text (VRT): one token or one tag a line; columns between tabs. Source and sink.

Blank lines count nowhere. An element without content (<x/>) holds no token and
is dropped from spans. Compressed files are read as their suffix says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaxis.operators.numbering import block_of, running_totals

_ENTITIES = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, value) of the lines that aren't blank; (file, block, row) is their order."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.where(F.trim("value") != "")


def events(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, kind, tag, cpos, depth, value) of every line.

    kind is open, close, empty or token; cpos the position of the token, or of
    the next one; depth the number of elements open before the line.
    """
    value = F.col("value")
    kind = F.when(value.startswith("</"), "close").when(value.startswith("<") & F.rtrim(value).endswith("/>"), "empty").when(value.startswith("<"), "open").otherwise("token")
    lines = read_lines(spark, path).withColumn("kind", kind)
    one = lambda k: F.when(F.col("kind") == k, 1).otherwise(0).cast("long")
    lines = running_totals(lines, ["file", "block"], ["row"], {"line_no": F.lit(1).cast("long"), "cpos": one("token"), "depth": one("open") - one("close")})
    tag = F.when(F.col("kind") != "token", F.regexp_extract(value, r"^</?([^\s/>]+)", 1))
    return lines.select("line_no", "kind", tag.alias("tag"), "cpos", "depth", "value")


def _unescaped(value: Column) -> Column:
    for entity, char in _ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def attributes(value: Column) -> Column:
    """The map of a start tag's attributes; of a repeated one the last counts."""
    names = F.regexp_extract_all(value, F.lit(r"([\w:.-]+)\s*=\s*\"([^\"]*)\""), 1)
    values = F.regexp_extract_all(value, F.lit(r"([\w:.-]+)\s*=\s*\"([^\"]*)\""), 2)
    values = F.transform(values, _unescaped)
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), lambda n: n == p.k)) == 0)
    return F.map_from_entries(last)


def spans(found: DataFrame, root: str | None = None) -> DataFrame:
    """(tag, depth, start, end, attrs) of every element of events(); wrong nesting is an error.

    Where elements are well nested, the n-th that opens at a depth is the n-th
    that closes there: both are numbered by depth and joined, so that a file of
    one element is as many tasks as any. Rootless files are fine. With `root`,
    one element of that name, over everything, stands above all others.
    """
    tags = found.where("kind in ('open', 'close')")
    level = F.when(F.col("kind") == "open", F.col("depth")).otherwise(F.col("depth") - 1)
    tags = tags.select("kind", "tag", level.alias("level"), "line_no", "cpos", "value", block_of(F.col("line_no")).alias("at"))
    sums = tags.groupBy("kind", "level", "at").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("kind", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("kind").alias("kind_of"), F.col("level").alias("level_of"), F.col("at").alias("at_of"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    joined = tags.join(offsets, (F.col("kind") == F.col("kind_of")) & (F.col("level") == F.col("level_of")) & (F.col("at") == F.col("at_of")))
    number = F.col("before") + F.row_number().over(Window.partitionBy("kind", "level", "at").orderBy("line_no"))
    numbered_tags = joined.select("kind", "tag", "level", "cpos", "value", number.alias("number"))
    opens = numbered_tags.where("kind = 'open'").drop("kind")
    closes = numbered_tags.where("kind = 'close'").select(F.col("level").alias("level_c"), F.col("number").alias("number_c"), F.col("tag").alias("tag_c"), F.col("cpos").alias("cpos_c"), F.col("value").alias("value_c"))
    pairs = opens.join(closes, (F.col("level") == F.col("level_c")) & (F.col("number") == F.col("number_c")), "full")
    fits = F.coalesce((F.col("tag") == F.col("tag_c")) & (F.col("cpos") <= F.col("cpos_c")), F.lit(False))
    end = F.when(fits, F.col("cpos_c")).otherwise(F.raise_error(F.concat(F.lit("not closed: "), F.coalesce("value", "value_c"))).cast("long"))
    found_spans = pairs.select(F.coalesce("tag", "tag_c").alias("tag"), F.col("level").cast("int").alias("depth"), F.col("cpos").alias("start"), end.alias("end"), attributes(F.coalesce("value", "value_c")).alias("attrs"))
    if root is None:
        return found_spans
    n = found.agg(F.count_if(F.col("kind") == "token").alias("end"))
    above = n.select(F.lit(root).alias("tag"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("start"), "end", F.create_map().cast("map<string,string>").alias("attrs"))
    return found_spans.withColumn("depth", F.col("depth") + 1).unionByName(above)


def outermost(found: DataFrame) -> DataFrame:
    """(line_no, tag) of the elements that no other holds; well-formed XML has one."""
    return found.where("kind = 'open' and depth = 0").select("line_no", "tag")


def tag_spans(found: DataFrame, tag: str) -> DataFrame:
    return spans(found).where(F.col("tag") == tag)


def annotation(found: DataFrame, tag: str, name: str) -> DataFrame:
    """(start, end, value) of one attribute; a tag that lacks it is an error."""
    value = F.col("attrs")[name]
    needed = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"<{tag}> without {name}")))
    return tag_spans(found, tag).select("start", "end", needed.alias("value"))


def token_column(found: DataFrame, index: int) -> DataFrame:
    """(cpos, value): one tab-separated column of the tokens; a line that lacks it is an error."""
    field = F.get(F.split("value", "\t"), F.lit(index))
    needed = F.when(field.isNotNull(), field).otherwise(F.raise_error(F.concat(F.lit(f"no column {index}: "), "value")))
    return found.where("kind = 'token'").select("cpos", needed.alias("value"))


def stats(found: DataFrame) -> DataFrame:
    """(what, n): tokens, columns of the first token line, and elements by name."""
    tokens = found.where("kind = 'token'").agg(F.count("*").alias("tokens"), F.coalesce(F.size(F.split(F.min_by("value", "cpos"), "\t")), F.lit(0)).cast("long").alias("columns"))
    totals = tokens.select(F.explode(F.array(F.struct(F.lit("tokens").alias("what"), F.col("tokens").alias("n")), F.struct(F.lit("columns").alias("what"), F.col("columns").alias("n")))).alias("r")).select("r.*")
    return totals.unionByName(found.where("kind = 'close'").groupBy(F.concat(F.lit("<"), "tag", F.lit(">")).alias("what")).agg(F.count("*").alias("n")))


def escaped(value: Column) -> Column:
    value = value.cast("string")
    for entity, char in reversed(_ENTITIES):
        if char in '&<"':
            value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def decode(tokens: DataFrame, docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(cpos, place, line): a corpus as VRT, in the order of cpos and place.

    Documents are <text id lang source>, lines are <s n>, tokens have the columns
    word and position in the document. No join: each row knows where it goes.
    """
    start, last = F.col("start"), F.col("end") - 1
    head = F.concat(F.lit('<text id="'), escaped(F.col("doc_id")), F.lit('" lang="'), escaped(F.coalesce("lang", F.lit(""))), F.lit('" source="'), escaped(F.coalesce("source", F.lit(""))), F.lit('">'))
    parts = [
        docs.select(start.alias("cpos"), F.lit(0).alias("place"), head.alias("line")),
        lines.select(start.alias("cpos"), F.lit(1).alias("place"), F.concat(F.lit('<s n="'), F.col("line_no").cast("string"), F.lit('">')).alias("line")),
        tokens.select("cpos", F.lit(2).alias("place"), F.concat_ws("\t", "word", F.col("pos_in_doc").cast("string")).alias("line")),
        lines.select(last.alias("cpos"), F.lit(3).alias("place"), F.lit("</s>").alias("line")),
        docs.select(last.alias("cpos"), F.lit(4).alias("place"), F.lit("</text>").alias("line")),
    ]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def write(decoded: DataFrame, path: str, compression: str = "none") -> None:
    """The files, in name order, hold the lines in corpus order."""
    decoded.repartitionByRange("cpos").sortWithinPartitions("cpos", "place").select("line").write.option("compression", compression).text(path)
