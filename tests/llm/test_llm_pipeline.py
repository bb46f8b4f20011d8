import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from inkloom.llm import catalog

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    assert [sum(n.startswith(f"op{i}_") for n in entry.queries()) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = sorted(catalog.QUERIES[name](spark, SF).columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in catalog.QUERIES[name](spark, SF).collect())
    want = sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE[name]})").fetchall()))
    assert got == want


def test_stages_keep_columns_and_only_remove(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert len(rows) <= n and len({r["doc_id"] for r in rows}) == len(rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs, n = spark.createDataFrame(rows, out.schema), len(rows)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
