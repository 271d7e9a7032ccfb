"""The pipeline and every corpus query on the smallest tables."""

import os

import pytest

import corpus_pipeline
from gridloom.llm import catalog
from gridloom.llm.common import materialise

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DATA), "test")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sum(r.length for r in packed) / 2048 / len({r.sequence_id for r in packed}) > 0.9


def test_empty_table(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), "test")
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(catalog.ORACLES[name])
    heads = [d[0] for d in cursor.description]
    expected = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, DATA).select(*heads).collect()) == expected


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES if n.startswith("op")) == list(range(1, 11))
