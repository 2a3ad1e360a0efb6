"""Every query with SQL gives the same rows as its SQL, at the smallest scale."""

import pytest
from conftest import DATA

from tessera import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    names, found = duck(queries.ORACLE_SQL[name])
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in found)


def test_generation_reaches_all_rows(spark, tmp_path):
    rows = [(i, [float(j == (i + 1) % 70) for j in range(70)]) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r.seq_id, r.step): r.token_id for r in queries.QUERIES["gen_loop_table"](spark, str(tmp_path)).collect()}
    assert found == {(i, k): (i % 64 + k) % 70 for i in range(80) for k in range(9)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
