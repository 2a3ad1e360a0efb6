"""Configurations as VARIANT columns: the rules of Config, on values of all kinds and on random trees."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.config import Config, loads, uncamel
from tessera.functions import variants as v

VALUES = [None, True, False, 0, 1, 2, -3, 1.0, 0.1, 1.5, "a", "T", "TRUE", "f", "0", "1", "", [], [1, "t"], ["t", 1], ["t", 1.0], [-1, "t"], ["t", "u"], [1, "t", 2], {}, {"a": 1}, {"a": True}, {"a": 1.0}, {"a": "t"}, {"b": 1}, [1], [True], [1.0], [[1]], {"a": {"b": [1, None]}}]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(i, json.dumps(x)) for i, x in enumerate(VALUES)]
    return spark.createDataFrame(rows, "i int, text string").withColumn("v", v.parse(F.col("text"))).cache()


def test_relaxed_json(spark):
    texts = {
        '﻿{"a": 1,}': '{"a":1}', '[1, 2, ]': "[1,2]", '{"a": ",] NaN Infinity \\" ,}", "b": [],}': '{"a":",] NaN Infinity \\" ,}","b":[]}', "[NaN, nan, -NaN]": "[null,null,null]",
        '{"a": 1, "a": 2}': None, "{": None, "": None, '{"a": 12345678901234567890}': '{"a":12345678901234567890}', '{"à": 1, "à": 2}': '{"à":2,"à":1}', "[1e3, 0.5]": "[1000.0,0.5]",
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    found = {r.t: r.j for r in df.select("t", v.encode(v.parse(F.col("t"))).alias("j")).collect()}
    assert found == {**texts, None: None}
    floats = spark.createDataFrame([("[Infinity, -Infinity, Inf, 1.1]",)], "t string").select(v.array(v.parse(F.col("t"))).alias("a"))
    assert floats.select(F.transform("a", v.floating).alias("f")).head().f == pytest.approx([float("inf"), float("-inf"), float("inf"), 1.1])


def test_typed(nodes):
    at = F.col("v")
    rows = nodes.select("i", v.kind(at).alias("kind"), v.string(at).alias("s"), v.integer(at).alias("n"), v.boolean(at).alias("b"), v.floating(at).alias("f"), v.token(at).alias("t"), F.size(v.array(at)).alias("items"), F.size(v.dictionary(at)).alias("entries"), v.string(at, "or").alias("d")).collect()
    for r in rows:
        c = Config(VALUES[r.i])
        assert (r.s, r.n, r.b, r.f) == (c.string(), c.integer(), c.boolean(), c.floating()), VALUES[r.i]
        assert (tuple(r.t) if r.t else None) == c.token(), VALUES[r.i]
        assert r.items == (len(c.value) if isinstance(c.value, list) else None) and r.entries == (len(c.value) if isinstance(c.value, dict) else None)
        assert r.d == c.string("or") and (r.kind == "null") == c.is_null


def test_equals(nodes):
    a, b = (nodes.select(F.col("i").alias(n), F.col("v").alias(f"v{n}")) for n in "ab")
    pairs = a.join(b, F.lit(True))
    rows = pairs.select("a", "b", v.equals(F.col("va"), F.col("vb")).alias("e"), (v.hashed(F.col("va")) == v.hashed(F.col("vb"))).alias("h")).collect()
    assert len(rows) == len(VALUES) ** 2
    for r in rows:
        assert r.e == (Config(VALUES[r.a]) == Config(VALUES[r.b])), (VALUES[r.a], VALUES[r.b])
        assert r.h == (r.a == r.b) or VALUES[r.a] == VALUES[r.b]


def test_paths(spark):
    rng = random.Random(5)
    keys = ["a", "maxLen", "max_len", "Bos", "x y", "it's", "ÉtÉ"]

    def tree(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice([None, True, 1, 2.5, "s"])
        return [tree(depth - 1) for _ in range(rng.randint(0, 3))] if rng.random() < 0.4 else {k: tree(depth - 1) for k in rng.sample(keys, rng.randint(0, 5))}

    rows = [json.dumps(tree(4)) for _ in range(200)]
    paths = [("a",), ("maxLen",), ("maxLen", 0), (1, "a"), ("x y", "it's"), ("maxLen", "maxLen"), (-1,), ("ÉtÉ",), ("a", "a", 1)]
    df = spark.createDataFrame([(t,) for t in rows], "t string").withColumn("v", v.parse(F.col("t")))
    for r in df.select("t", *(v.encode(v.get(F.col("v"), *p)).alias(f"p{k}") for k, p in enumerate(paths))).collect():
        for k, p in enumerate(paths):
            node = loads(r.t)
            for step in p:
                node = node[step]
            assert (None if r[f"p{k}"] is None else json.loads(r[f"p{k}"])) == node.value, (r.t, p)
    named = spark.createDataFrame([("maxLen", '{"max_len": 3}'), ("b", '{"max_len": 3}')], "k string, t string")
    assert [x[0] for x in named.select(v.integer(v.get(v.parse(F.col("t")), F.col("k")))).collect()] == [3, None]


def test_keys_merge_and_entries(spark):
    names = ["camelCase", "ABc", "aBC", "already_snake", "x1Y", "éÉ", "", "A", "modelMaxLength"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [(r.n, r.u) for r in df.select("n", v.uncamel(F.col("n")).alias("u")).collect()] == [(n, uncamel(n)) for n in names]
    assert uncamel("aBC") == "a_bc" and uncamel("ABc") == "abc"
    pairs = [('{"a": 1, "b": 2}', '{"b": {"x": 1}, "c": null}'), (None, '{"a": 1}'), ('{"a": 1}', None), ('{"a": 1}', "null")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, l string, r string")
    df = df.select("i", v.merged(v.parse(F.col("l")), v.parse(F.col("r"))).alias("m"))
    assert [r[0] for r in df.orderBy("i").select(v.encode(F.col("m"))).collect()] == ['{"a":1,"b":{"x":1},"c":null}', '{"a":1}', '{"a":1}', '{"a":1}']
    rows = v.entries(df, "m").select("i", "pos", "key", v.encode(F.col("value")).alias("value")).where("i = 0").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "a", "1"), (0, 1, "b", '{"x":1}'), (0, 2, "c", "null")]
    items = spark.createDataFrame([("[5, [6]]",), ("3",)], "t string").select(v.parse(F.col("t")).alias("m"))
    assert [(r.key, v_) for r in v.entries(items, "m").select("key", v.encode(F.col("value")).alias("value")).collect() for v_ in [r.value]] == [(None, "5"), (None, "[6]")]
    assert v.entries(items, "m", outer=True).count() == 3
