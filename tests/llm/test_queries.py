"""Registered queries and the pipeline on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from renewlake.llm import oracles, queries

DEALT = set(range(1, 14))
TABLES = ("documents", "embeddings", "labels")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_twin(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(oracles.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_one_query_each():
    assert [int(k[2:].split("_")[0]) for k in sorted(queries.QUERIES, key=lambda k: int(k[2:].split("_")[0]))] == sorted(DEALT)


def test_pipeline_stages(spark, sf):
    """Every stage against its operator's own result on the stage's input."""
    from renewlake.llm import line_dedup, mixing, ngram_join, quality
    from renewlake.llm.common import crc_mod, read_table, stored

    docs = read_table(spark, sf, "documents")
    names = corpus_pipeline.DOCUMENT_COLUMNS
    out = [stored(docs.select(names), "start")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), name))
        assert name == "bpe" or out[-1].columns == names
    rows = [sorted(map(tuple, d.collect())) for d in out]
    model = quality.train_quality(out[0], read_table(spark, sf, "labels"), crc_mod("doc_id", 5) != 0)
    fine = {r.doc_id for r in quality.score_quality(out[0], model).where("score >= 0.3").collect()}
    assert rows[1] == [r for r in rows[0] if r[0] in fine]
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(out[1]).collect()}
    assert [(r[0], r[1], r[4]) for r in rows[2]] == [(r[0], texts[r[0]], len(texts[r[0]])) for r in rows[1]]
    kept = {r.doc_id for r in ngram_join.jaccard_components(out[2], size=5, percent=80).where("doc_id = component_id").collect()}
    assert rows[3] == [r for r in rows[2] if r[0] in kept]
    copies = sorted(r.doc_id for r in mixing.mix_sources(out[3]).collect())
    assert sorted(r[0] for r in rows[4]) == copies == sorted(r[0] for r in rows[5])
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, ran.collect())) == rows[5]
    assert ran.where(F.col("n_tokens") < 0).count() == 0
