"""Registered corpus queries: names, SQL twins, and the pipeline against its stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline


def test_names():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["op6_certified_rules", "op8_url_rules", "op11_fill_in_middle", "op12_importance_resampling", "op13_chat_format"])
def test_sql_twin(spark, small, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "labels", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = entry.queries()[name](spark, small)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (docs, out)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        docs = out
    before, after = seen["quality classifier"]
    assert 0 < after.count() < before.count() and after.exceptAll(before).count() == 0
    before, after = seen["line dedup"]
    assert after.count() == before.count() and after.agg(F.sum(F.length("text"))).first()[0] < before.agg(F.sum(F.length("text"))).first()[0]
    before, after = seen["SimHash near-dedup"]
    assert after.exceptAll(before).count() == 0 and after.count() < before.count()
    before, after = seen["mixing"]
    assert after.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    packed = seen["packing"][1].agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("docs")).first()
    assert packed["docs"] == after.count()
    whole = corpus_pipeline.run(spark, small).agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("docs")).first()
    assert whole == packed


def test_pipeline_on_edge_cases(spark, docs, labels, none, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for i, start in enumerate((docs, none)):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}-{k}")
            now = spark.read.parquet(f"{tmp_path}/{i}-{k}")
        assert (now.count() > 0) == (start is docs)
