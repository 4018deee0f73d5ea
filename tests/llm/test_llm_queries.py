"""The registered corpus queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import os
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from brute import brute_components, shingles

from ledgerspark.llm import mixing, oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SF):
        table = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{file}'")
    cursor = connection.execute(oracle.SQL[name])
    columns = [c[0] for c in cursor.description]
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(frame.columns)
    at = [frame.columns.index(c) for c in columns]
    found = sorted(repr([row[i] for i in at]) for row in frame.collect())
    assert found == sorted(repr(list(row)) for row in cursor.fetchall())


def test_pipeline_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        seen[name] = (docs.collect(), docs)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
    before, after = seen["exact_dedup"][0], seen["near_dedup"][0]
    assert len(after) == len({r.text for r in before})
    assert {r.doc_id for r in after} == {max(r.doc_id for r in before if r.text == t) for t in {r.text for r in before}}
    label = brute_components({r.doc_id: shingles(r.text, 5) for r in after}, 80)
    near = seen["source_mix"][0]
    assert sorted(r.doc_id for r in near) == sorted(d for d in label if label[d] == d)
    times = {r.doc_id: r.times for r in mixing.mix(seen["source_mix"][1]).collect()}
    mixed = Counter(r.doc_id for r in seen["best_fit_packing"][0])
    assert mixed == Counter({d: n for d, n in times.items() if n})
    packed = docs.collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed
    assert all(r.offset + r.length <= 1024 for r in packed)


def test_pipeline_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def rows(frame):
        return sorted(tuple(r) for r in frame.select(*columns).collect())

    assert rows(corpus_pipeline.run(spark, SF)) == rows(docs)
