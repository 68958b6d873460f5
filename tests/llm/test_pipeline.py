"""The pipeline on the smallest tables: each stage works on what the one before kept."""

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cohortloom.llm import queries
from cohortloom.llm.common import DOCUMENT_COLUMNS
from cohortloom.session import materialise

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


def test_stages_and_run_agree(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(FOLDER)), "test-stage")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2] and len(ids[-1]) > 0.6 * len(ids[0]), name
        if name != "packing":
            assert tuple(docs.columns) == DOCUMENT_COLUMNS
    assert ids[-1] == ids[-2]
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(FOLDER)).collect():
        pieces[r.doc_id].append(r)
        assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
    assert pieces.keys() == ids[-1]
    assert all(sum(r.length for r in p) == p[0].doc_tokens for p in pieces.values())


def test_every_operator_is_registered():
    registered = entry.queries()
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 14))
    assert registered.keys() >= queries.QUERIES.keys() | {"pipeline"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_statements(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = queries.QUERIES[name](spark, str(FOLDER))
    res = db.execute(queries.ORACLES[name])
    columns = [d[0] for d in res.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(res.fetchall(), key=str)
