"""The pipeline's stages in a row, and the registered queries."""

import os

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_stages(spark, tmp_path):
    import corpus_pipeline
    from tabstat.llm import near_dup, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        result = spark.read.parquet(str(tmp_path / name))
        if name == "near_dedup":
            assert result.count() == near_dup.classes(docs).select("class_id").distinct().count()
        if name == "secrets":
            assert not any(secrets.base_spans(r.text) for r in result.collect())
        if name != "packing":
            assert result.columns == columns and 0 < result.count() <= before
            before = result.count()
            docs = result
    assert result.where("piece = 0").count() == before


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", ["op2_warc", "op4_chat", "op5_top_k"])
def test_oracle(spark, name):
    import sys

    duckdb = pytest.importorskip("duckdb")
    sys.path.insert(0, os.path.join(ROOT, "scripts"))
    from oracle_check import TABLES, canon
    from tabstat.llm import queries

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canon([tuple(r) for r in frame.collect()], frame.columns) == canon(got.fetchall(), columns)
