"""Table functions in SQL: logits processors of one's own, and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import logits, subword, tables

LOGITS = "row_id long, token_id int, score double, ids array<long>"


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(1)
    rows = [(r, t, float(rng.normal() * 3), [int(i) for i in rng.integers(0, 12, 9)] if t == 0 else None) for r in range(40) for t in range(12)]
    ids = {r[0]: r[3] for r in rows if r[1] == 0}
    rows = [(r, t, s, ids[r]) for r, t, s, _ in rows]
    df = spark.createDataFrame(rows, LOGITS).repartition(7, "token_id").cache()
    df.createOrReplaceTempView("some_logits")
    return df


def by_row(rows):
    of = {}
    for r in rows:
        of.setdefault(r.row_id, {})[r.token_id] = r.score
    return {r: [x[t] for t in sorted(x)] for r, x in of.items()}


def test_a_processor_of_ones_own(spark, scores):
    @tables.register("halved")
    def halved(even: bool = True):
        return lambda x, ids: np.where(np.arange(len(x)) % 2 == (0 if even else 1), x / 2, x)

    try:
        tables.register_functions(spark, processors={"halved_odd": tables.processor("halved", even=False)})
        found = by_row(spark.sql("SELECT * FROM halved_odd(TABLE(SELECT row_id, token_id, score FROM some_logits) PARTITION BY row_id)").collect())
        assert found == {r: [x / 2 if i % 2 else x for i, x in enumerate(xs)] for r, xs in by_row(scores.collect()).items()}
        # beside the windows of the plan
        steps = [logits.temperature(0.5), tables.warp(tables.processor("halved")), logits.top_k(3)]
        kept = by_row(logits.apply(scores.select("row_id", "token_id", "score"), steps).collect())
        assert all(sum(np.isfinite(xs)) == 3 for xs in kept.values()) and len(kept) == 40
    finally:
        del tables.PROCESSORS["halved"]
    with pytest.raises(ValueError, match="unknown"):
        tables.processor("halved")


def test_processors_see_the_ids(spark, scores):
    tables.register_functions(spark, processors={"no_pairs": tables.processor("no_repeat_ngram", size=2)})
    found = by_row(spark.sql("SELECT * FROM no_pairs(TABLE(some_logits) PARTITION BY row_id)").collect())
    for r in scores.where("token_id = 0").collect():
        ids = list(r.ids)
        banned = {b for a, b in zip(ids, ids[1:], strict=False) if a == ids[-1]}
        assert {i for i, x in enumerate(found[r.row_id]) if x == -np.inf} == banned
    assert tables.no_repeat_ngram(1)(np.zeros(3), [2, 2]).tolist() == [0, 0, -np.inf]
    assert tables.no_repeat_ngram(3)(np.zeros(3), [1]).tolist() == [0, 0, 0]
    assert tables.epsilon_cutoff(0.9)(np.array([1.0, 1.0]), []).tolist() == [1.0, -np.inf]
    for wrong in (lambda: tables.epsilon_cutoff(1), lambda: tables.no_repeat_ngram(0)):
        with pytest.raises(ValueError):
            wrong()


def test_wrong_tables_are_told(spark, scores):
    tables.register_functions(spark, processors={"checked": tables.processor("epsilon_cutoff", epsilon=0.1)})
    with pytest.raises(Exception, match="no column score"):
        spark.sql("SELECT * FROM checked(TABLE(SELECT row_id, token_id FROM some_logits) PARTITION BY row_id)").collect()
    with pytest.raises(Exception, match="PARTITIONED BY"):
        spark.sql("SELECT * FROM checked(TABLE(SELECT /*+ COALESCE(1) */ row_id, token_id, score FROM some_logits))").collect()


def test_models_in_sql(spark):
    model = subword.Bpe({"a": 0, "b": 1, "ab": 2, "<u>": 3}, ["a b"], unk="<u>")
    tables.register_functions(spark, models={"bpe_tokens": model})
    df = spark.createDataFrame([(1, ["ab", "ba"]), (2, []), (3, None), (4, ["b", None, "ab"])], "row_id long, pieces array<string>")
    rows = spark.sql("SELECT * FROM bpe_tokens(TABLE({rows}))", rows=df).orderBy("row_id", "pos").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "ab", 2), (1, 1, "b", 1), (1, 2, "a", 0), (4, 0, "b", 1), (4, 1, "ab", 2)]
    plan = spark.sql("SELECT * FROM bpe_tokens(TABLE({rows}))", rows=df.withColumn("row_id", F.col("row_id") + 1))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
