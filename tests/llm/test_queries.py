"""Queries of the subpackage with SQL, against DuckDB; and the others' shape."""

import os

import duckdb
import numpy as np
import pytest

from quillmere.llm.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def rows(df):
    plain = lambda v: "" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, folder, duck, name):
    got, want = QUERIES[name](spark, folder).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_whitening_of_the_table(spark, folder, duck):
    """All rows of op12 against NumPy over exact integers; components have either sign."""
    got = QUERIES["op12_embedding_whitening"](spark, folder).toPandas().sort_values(["component", "vec_id"])
    assert list(map(str, got.dtypes[["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]])) == ["int64", "int32", "int64", "int64", "float64", "float64", "float64"]
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id").fetchall()
    x = np.floor(np.array([v for _, v in rows], float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums).astype(object)
    deviation = (centred * centred).sum(axis=1)
    c = centred.astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    white = (c @ vectors / np.sqrt(values))[:, ::-1]
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-10
    for k in range(8):
        own = got[got["component"] == k + 1]
        assert list(own["vec_id"]) == [i for i, _ in rows] and list(own["deviation"]) == list(deviation)
        sign = np.sign(own["whitened"].iloc[0] * white[0, k])
        assert np.allclose(own["whitened"], sign * white[:, k], atol=1e-8) and np.allclose(own["explained"], values[::-1][k] / values.sum(), rtol=1e-12)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op12_embedding_whitening"}))
def test_one_row_a_document(spark, folder, name):
    got = QUERIES[name](spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
