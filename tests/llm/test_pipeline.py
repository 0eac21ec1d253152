"""The pipeline's stages on a small folder, and the queries' SQL."""

from __future__ import annotations

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "substring dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toPandas(), docs.schema)
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids and docs.count() == len(left)
        ids = left
    assert 0.5 * n < len(ids) < n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op11_spelling_variants", "op12_warc_records", "op13_merkle_manifest"])
def test_sql(spark, name):
    import duckdb

    from spindrift.llm import entry

    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    sql = db.sql(entry.oracle_sql()[name])
    rows = entry.queries()[name](spark, FOLDER).select(*sql.columns)
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, sql.fetchall()))


def test_the_fit_leaves_the_drivers_memory_as_it_was(spark, monkeypatch):
    """What the fit needed goes back to the system, though its model lies above it in memory."""
    import numpy as np

    from spindrift.llm import toxicity
    from spindrift.llm.common import table

    def train(*_):
        work = [np.ones(1_000) for _ in range(25_000)]
        return {"weights": work.pop()}

    held = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) // 1024
    monkeypatch.setattr(toxicity, "train", train)
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    before = held()
    model = toxicity.fitted(docs, labels)
    assert len(model["weights"]) == 1_000 and held() - before < 80
