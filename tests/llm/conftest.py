import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

#: The columns of documents and one that clashes with many names inside the operators.
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
CLASHING = ("print", "version", "score", "n_lines", "component_id", "spans", "hash", "key", "shard", "doc")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows, with further columns of clashing names."""

    def made(rows, clashing=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clashing:
            for name in CLASHING:
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return made


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and very long texts, ties, repeated rows and equal texts."""
    long = " ".join(f"w{i % 977} x{i % 31}\n" if i % 50 == 0 else f"w{i % 977}" for i in range(30_000))
    return [
        (1, "The first line of them\nshort\nA line in two documents"), (2, None), (3, ""), (4, "   \t\n "), (5, long),
        (6, "  a LINE in two documents \nanother one of its own"), (7, "The first line of them\nshort\nA line in two documents"),
        (7, "The first line of them\nshort\nA line in two documents"), (None, "a line in two documents"), (8, "12345 !!"),
        (9, "äöü é 日本語 ñ"), (10, "x" * 300), (11, "ab" * 200 + " " + "ab" * 200), (12, long + " end"), (None, None), (13, "one"),
    ]
