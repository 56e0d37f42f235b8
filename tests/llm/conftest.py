import pytest

LONG = " ".join(f"wort{i % 997} satz{i % 31}." for i in range(60_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, fp string, node int, label string, line binary, owner int, kept_line_numbers int, row_number_in_files int, query string, bounds_of_ranges int, part int, pack_id int"
EXTRA = ("x", "y", 1, None, None, 2, 3, 4, "q", 5, 6, 7)


def document(doc_id, text, lang="de", source="s"):
    return (doc_id, text, lang, source, len(text or ""), *EXTRA)


NASTY = [
    document(1, "eins zwei drei\nvier\n\nfünf"),
    document(1, "eins zwei drei\nvier\n\nfünf"),
    document(2, None),
    document(3, ""),
    document(4, "   \n\t\n "),
    document(None, "ohne Nummer aber mit Text"),
    document(None, "ohne Nummer aber mit Text"),
    document(None, None, None, None),
    document(5, LONG, None, None),
    document(6, LONG),
    document(7, "a" * 300_000),
    document(8, "sch\u0000\u0001▁ � 😀 x"),
    document(9, "eins zwei drei\nvier\n\nfünf"),
]


@pytest.fixture(scope="session")
def nasty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nasty") / "t")
    spark.createDataFrame(NASTY, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
