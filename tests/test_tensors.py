"""Tensor files: conditions that are planned, writes that commit once."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import tensors


@pytest.fixture()
def folder(spark, tmp_path):
    tensors.register(spark)
    rng = np.random.default_rng(0)
    for f in "ab":
        tensors.write_tensors(str(tmp_path / f"{f}.safetensors"), {f"{f}.{i}": rng.normal(size=(3, i + 1)).astype("<f4") for i in range(5)})
    return str(tmp_path)


def read(spark, path):
    return spark.read.format("safetensors").load(path)


def test_globs_choose_ranges(spark, folder):
    assert read(spark, folder).rdd.getNumPartitions() == 10
    for options, n in (({"names": ["a.1"]}, 1), ({"names": ["a.1", "b.2", "c"]}, 2), ({"names": ["a.*"]}, 5), ({"names": ["*.3"]}, 2), ({"paths": ["*b.safetensors"], "names": ["?.[34]"]}, 2), ({"names": []}, 0)):
        found = tensors.read(spark, folder, **options)
        assert (found.rdd.getNumPartitions(), found.count()) == (max(n, 1), n), options
    # another file is not even opened
    with open(f"{folder}/c.safetensors", "wb") as f:
        f.write(b"no header")
    one = tensors.read(spark, folder, paths=["*/a.safetensors"])
    assert one.count() == 5 and one.where("name = 'a.1'").count() == 1 and one.count() == 5
    with pytest.raises(Exception, match="header"):
        read(spark, folder).count()


def test_written_and_read_again(spark, folder, tmp_path):
    out = f"file://{tmp_path}/out"
    big = {"big": np.arange(tensors.ROW * 2 + 7, dtype="<i4"), "none": np.zeros((0, 2), dtype="<f8")}
    tensors.write_tensors(f"{folder}/d.safetensors", big)
    rows = read(spark, folder)
    tensors.write(rows, out, partitions=3)
    columns = ["name", "dtype", "shape", "start", F.sha2(F.to_json("values"), 256).alias("values")]
    wanted = sorted(map(tuple, rows.select(*columns).collect()), key=str)
    assert sorted(map(tuple, read(spark, out).select(*columns).collect()), key=str) == wanted
    files = os.listdir(tmp_path / "out")
    assert len(files) <= 3 and all(f.endswith(".safetensors") for f in files)
    tensors.write(rows.where("name = 'a.1'"), out, mode="overwrite")
    assert [r.name for r in read(spark, out).collect()] == ["a.1"] and len(os.listdir(tmp_path / "out")) == 1
    with pytest.raises(ValueError):
        tensors.write(rows, out, mode="ignore")


@pytest.mark.parametrize("bad", ["start > 0", "name = 'a.2'"])
def test_a_failed_write_leaves_nothing(spark, folder, tmp_path, bad):
    """Values that are missing, and an error in one of the tasks."""
    tensors.write_tensors(f"{folder}/d.safetensors", {"big": np.arange(tensors.ROW + 7, dtype="<i4")})
    rows = read(spark, folder)
    rows = rows.where(bad) if bad.startswith("start") else rows.withColumn("start", F.when(F.expr(bad), F.raise_error(F.lit("lost"))).otherwise(F.col("start")))
    with pytest.raises(Exception, match="missing|lost"):
        tensors.write(rows, f"{tmp_path}/out", partitions=4)
    assert not os.path.exists(tmp_path / "out") or not os.listdir(tmp_path / "out")
