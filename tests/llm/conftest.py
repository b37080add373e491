import pytest
from pyspark.sql import types as T

WORDS = "of the and thing erst haon nd ble tion ou er re at en es on in ing or it".split()

#: documents, with columns whose names the operators use inside.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("score", "keep_id", "size", "pi", "whole", "cut", "id", "rep", "bucket", "salt", "norm", "label", "target")]
)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *(["x"] * 13))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    import random

    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    base = prose(80)
    changed = base.split()
    changed[40] = "zzz"
    rows = [
        row(1, base), row(2, base), row(3, "  " + base.replace(" ", "\t\n ", 3)), row(4, " ".join(changed)), row(5, None), row(6, ""), row(7, " \n\t "), row(8, None, None, None),
        row(9, "word"), row(10, "one two three"), row(11, prose(30_000), "de", "b"), row(12, "x" * 50_000), row(13, "né  ça  　 汉字 😀   end ", None, "b"), row(None, prose(20)), row(None, None, None, None),
        row(14, prose(25), "de", None), row(14, prose(25), "de", None), row(15, "same"), row(15, "same"), row(16, "a@b.co or +1 (555) 123-4567 or 10.0.0.1 or 4111 1111 1111 1111"), row(17, prose(60), "fr", "c"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def more_tables(tables):
    """The next larger test tables, where every planted case occurs."""
    import os

    path = tables.replace("sf0.001", "sf0.01")
    return path if os.path.isdir(path) else tables
