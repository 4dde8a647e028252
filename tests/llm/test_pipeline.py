"""The queries with SQL twins, and the pipeline's stages against brute force."""

import sys
from pathlib import Path

import duckdb
import pytest
from brute import brute_lines, shingle_set, survivors
from comparing import mismatch

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from quayside.llm import oracle, queries  # noqa: E402
from quayside.llm.common import table, written  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, SMALL)
    sql = oracle.oracle_sql()[name]
    if name.startswith("op6"):  # lists of numbers are compared as texts
        df = df.withColumn("item_ids", df.item_ids.cast("string"))
        sql = f"SELECT * REPLACE (CAST(item_ids AS VARCHAR) AS item_ids) FROM ({sql})"
    assert mismatch(df, con, sql) is None


def test_stages(spark):
    docs, columns = table(spark, SMALL, "documents"), table(spark, SMALL, "documents").columns
    items = [set(shingle_set(r.text)) for r in table(spark, SMALL, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, SMALL), "test-stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
            assert len(after) >= 0.99 * len([t for t in before.values() if any(map(str.isalpha, t or ""))])
        elif name == "line_dedup":
            assert after == {i: t for i, t, _, _ in brute_lines(sorted(before.items()))}
        elif name == "near_dedup":
            assert set(after) == survivors(before.items())
        elif name == "decontamination":
            hit = {i for i, t in before.items() if any(s and len(s & shingle_set(t)) >= 0.8 * len(s) for s in items)}
            assert set(after) == set(before) - hit
        else:
            assert after == before and docs.columns == ["doc_id", "n_tokens", "ids", "text"]
            continue
        assert docs.columns == columns


def test_stages_on_awkward_rows(spark, make, awkward):
    for rows in (awkward, []):
        docs = make(rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SMALL), "test-stage")
            assert name == "byte_bpe" or docs.columns == columns
        assert docs.count() <= len(rows)
