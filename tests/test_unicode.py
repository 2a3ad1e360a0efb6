"""Normal forms against Python's, on every character that matters and on mixtures of them."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import normalize, unicode_forms


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    special = sorted({*unicode_forms.classes(), *unicode_forms.compatible(), *(x for p in unicode_forms.pairs() for x in p), *(chr(c) for c in range(0x1100, 0x1200)), *(chr(c) for c in range(0xAC00, 0xD7A4, 7))})
    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x800 or c % 23 == 0)]
    rows = {*special, *plain, *("a" + c + "́" for c in special), ""}
    marks = sorted(unicode_forms.classes())
    for _ in range(4000):
        rows.add("".join(rng.choice([rng.choice(special), rng.choice(marks), rng.choice(plain), rng.choice("aeoE \n")]) for _ in range(rng.randint(2, 9))))
    df = spark.createDataFrame([(t,) for t in sorted(rows)] + [(None,)], "t string").repartition(4).cache()
    df.count()
    return df


@pytest.mark.parametrize("name", unicode_forms.FORMS)
def test_forms(texts, name):
    rows = texts.select("t", unicode_forms.normal(F.col("t"), name).alias("o")).collect()
    assert len(rows) > 20_000
    wrong = [(ascii(r.t), ascii(r.o)) for r in rows if r.o != (None if r.t is None else unicodedata.normalize(name, r.t))]
    assert not wrong, wrong[:5]


def test_arrays_and_long_texts(spark):
    """Also within arrays, as sections of texts are; and very long runs of one kind."""
    long = ["é" * 200_000, "x" * 300_000 + "́", "ẹ́" * 50_000, "Ａ" * 100_000]
    df = spark.createDataFrame([(long,)], "a array<string>")
    step = normalize.form("NFKC")
    assert df.select(step.array(F.col("a")).alias("a")).head().a == [unicodedata.normalize("NFKC", x) for x in long]
    assert [unicodedata.normalize("NFD", x) for x in long] == df.select(normalize.form("NFD").array(F.col("a")).alias("a")).head().a
    with pytest.raises(ValueError):
        unicode_forms.normal(F.col("a"), "NF")


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("x",)], "t string").select(*(normalize.normalize(F.col("t"), normalize.normalizer({"type": k})) for k in ("NFC", "NFD", "NFKC", "NFKD", "StripAccents", "Precompiled")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_precompiled(spark):
    texts = ["～", "a～～ﬁ", "\x01ﬁ​\tＡ", "～²～"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    out = [r[0] for r in df.orderBy("i").select(normalize.normalize(F.col("t"), normalize.normalizer({"type": "Precompiled"}))).collect()]
    assert out == ["", "a～fi", "fi  A", "2"]
