"""The queries of clustering, licences and divergence against their SQL in DuckDB: on the tables, and on odd rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.llm import queries
from tests.llm.conftest import key

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = ("op11_centroids", "op12_licenses", "op13_divergence")


def compare(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.execute(queries.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    rows = key(map(tuple, got.collect()))
    assert rows == key(want.fetchall())
    return rows


@pytest.mark.parametrize("name", NAMES)
def test_on_the_tables(spark, name):
    assert compare(spark, SF_DIR, name)


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory, odd_docs):
    path = str(tmp_path_factory.mktemp("odd"))
    other = odd_docs.where("doc_id % 3 = 0").withColumn("source", F.concat(F.lit("other"), (F.col("doc_id") % 2).cast("string")))
    odd_docs.union(other).write.parquet(f"{path}/documents.parquet")
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7) * 0.3 - 0.5] * 63 + [i / 9], 1) for i in range(60)] + [(1, [0.25] * 64, 1), (1, [0.25] * 64, 1), (70, [0.1] * 63, 1), (71, [0.1] * 63 + [None], 1), (72, [0.1] * 63 + [nan], 1), (73, [0.1] * 63 + [-inf], 1), (74, None, 1), (75, [], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_on_odd_rows(spark, odd_tables, name):
    assert compare(spark, odd_tables, name)
