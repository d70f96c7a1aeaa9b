"""Images whose last rows are missing, as where the number of arrays is no multiple of 50, against the queries' SQL."""

import duckdb
import pytest

from tidemark import plans


@pytest.mark.parametrize("name", ["n5_table_to_heatmap", "i9_classic_morphology", "i9_classic_morphology_5", "i9_classic_morphology_7"])
def test_partial_image(spark, tmp_path, name):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 54 and vec_id <> 20")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(plans.oracle_sql()[name]).fetchall()
    got = plans.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
