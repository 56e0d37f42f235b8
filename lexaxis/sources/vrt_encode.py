"""Encodes VRT files as a corpus: ``python -m lexaxis.sources.vrt_encode INPUT -o FOLDER -p word -p pos -s s -a s+id:plain``."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaxis.functions.parsing import int_parse, pointer_from, set_parse
from lexaxis.operators import lexicon, segments
from lexaxis.operators.numbering import block_of, numbered
from lexaxis.sources import vrt
from lexaxis.sources.corpus import KINDS, Corpus, CorpusError
from lexaxis.sources.shared import settled


#: A token column that isn't encoded, though pointers may count from it.
SKIP = "skip"


def _declared(text: str, default: str, *more: str) -> tuple[str, str]:
    name, _, kind = text.partition(":")
    kind = kind or default
    if kind not in KINDS + more:
        raise CorpusError(f"unknown type {kind!r} of {name!r}")
    return name, kind


def _typed(value, kind: str, int_default: int | None):
    return int_parse(value, int_default) if kind in ("int", "delta") else set_parse(value) if kind == "set" else value


def encode_vrt(
    spark: SparkSession,
    source: str,
    folder: str,
    p: list[str],
    s: list[str] = (),
    a: list[str] = (),
    int_default: int | None = None,
    ptr_base: str | None = None,
    force: bool = False,
    uncompressed: bool = False,
    invalid_xml: bool = False,
) -> Corpus:
    """Declarations as on the command line: p "name[:type]" by column, s "tag", a "tag+attribute[:type]".

    Types are indexed, plain, int, delta (an integer stored by differences), set
    and, for one token column at most, ptr; `skip` leaves a column out. A pointer
    leads from its token to cpos + (head - base), where `base` is the value of
    the column that `ptr_base` names, in the same line; 0 is the token itself,
    and what is no number, in either column, points nowhere. Elements of one tag
    must not overlap. Several outermost elements are an error, unless
    `invalid_xml` puts one above them; an existing folder is one unless `force`.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at):
        if not force:
            raise CorpusError(f"{folder} is there already")
        files.delete(at, True)
    columns = [_declared(x, "indexed", SKIP) for x in p]
    names, kept = [n for n, _ in columns], [(n, k) for n, k in columns if k != SKIP]
    if len({*names, "cpos"}) <= len(names) or len(set(s)) < len(s):
        raise CorpusError("a name is declared twice, or is cpos")
    pointers = [n for n, k in columns if k == "ptr"]
    if len(pointers) > 1 or any(x.endswith(":ptr") for x in a):
        raise CorpusError("one token column at most holds pointers")
    if pointers and ptr_base not in names:
        raise CorpusError(f"pointers need a column to count from, and {ptr_base!r} is none")

    def write(df: DataFrame, name: str, *by: str) -> DataFrame:
        writer = df.repartitionByRange(*by).sortWithinPartitions(*by).write
        if uncompressed:
            writer = writer.option("compression", "none")
        writer.option("parquet.writer.version", "v2").parquet(f"{folder}/{name}")  # v2: integers by differences
        return spark.read.parquet(f"{folder}/{name}")

    found = vrt.events(spark, source)
    if s and not invalid_xml and len(vrt.outermost(found).head(2)) > 1:
        raise CorpusError("the input has several outermost elements")
    fields = F.split("value", "\t")
    short = F.raise_error(F.concat(F.lit("too few columns: "), F.col("value")))
    raw = {n: F.coalesce(F.get(fields, F.lit(i)), short) for i, n in enumerate(names)}
    value = {n: pointer_from(F.col("cpos"), raw[n], raw[ptr_base]) if k == "ptr" else _typed(raw[n], k, int_default) for n, k in kept}
    tokens = write(found.where("kind = 'token'").select("cpos", *(v.alias(n) for n, v in value.items())), "tokens", "cpos")
    n = tokens.count()
    rows = [("tokens", None, name, kind, n) for name, kind in kept or [(None, None)]]
    for name, kind in kept:
        if kind == "indexed":
            write(lexicon.build(tokens.select("cpos", F.col(name).alias("word"))), f"lexicon_{name}", "id")
        if kind == "ptr" and tokens.where((F.col(name) < 0) | (F.col(name) >= n)).head(1):
            raise CorpusError(f"{name} points outside the corpus")
    for tag in s:
        kinds = [_declared(x.split("+", 1)[1], "plain") for x in a if x.split("+", 1)[0] == tag]
        spans = vrt.spans(found, "root" if invalid_xml else None).where(F.col("tag") == tag).where("start < end").withColumns({"block": block_of(F.col("start"))})
        layer = numbered(settled(spans), ["block"], ["start", "end"], "seg_id")
        needed = {x: F.coalesce(F.col("attrs")[x], F.raise_error(F.lit(f"<{tag}> without {x}"))) for x, _ in kinds}
        layer = write(layer.select("seg_id", "start", "end", *(_typed(needed[x], kind, int_default).alias(x) for x, kind in kinds)), f"seg_{tag}", "start")
        if segments.overlaps(layer).head(1):
            raise CorpusError(f"<{tag}> elements overlap")
        rows += [(f"seg_{tag}", "tokens", name, kind, layer.count()) for name, kind in kinds or [(None, None)]]
    uids = {layer: str(uuid.uuid5(uuid.NAMESPACE_URL, f"{folder}/{layer}")) for layer, *_ in rows}
    manifest = spark.createDataFrame([(x, b, v, k, uids[x], m) for x, b, v, k, m in rows], "layer string, base string, variable string, kind string, uuid string, n long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return Corpus.open(spark, folder)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("-o", "--output")
    parser.add_argument("-f", action="store_true", help="replace the output folder")
    parser.add_argument("-u", action="store_true", help="write tables without compression")
    parser.add_argument("-x", action="store_true", help="put one element above several outermost ones")
    parser.add_argument("-p", action="append", default=[], metavar="NAME[:TYPE]", help="a token column, in order; type skip leaves it out")
    parser.add_argument("-s", action="append", default=[], metavar="TAG", help="a segment layer")
    parser.add_argument("-a", action="append", default=[], metavar="TAG+ATTRIBUTE[:TYPE]", help="an annotation of a layer")
    parser.add_argument("--int-default", type=int, help="in place of invalid integers, which are errors without it")
    parser.add_argument("--ptr-base", metavar="NAME", help="the token column that pointers count from")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if not given.p and not given.s:
        vrt.stats(vrt.events(spark, given.input)).show(1000, truncate=False)
        return
    if not given.output:
        given.output = given.input.removesuffix(".gz").removesuffix(".vrt")
        if given.output == given.input:
            parser.error("-o is needed, as the input has no suffix to leave out")
    if wrong := [x for x in given.a if "+" not in x or x.split("+", 1)[0] not in given.s]:
        parser.error(f"annotations of layers that aren't declared: {wrong}")
    encode_vrt(spark, given.input, given.output, given.p, given.s, given.a, given.int_default, given.ptr_base, given.f, given.u, given.x)


if __name__ == "__main__":
    main()
