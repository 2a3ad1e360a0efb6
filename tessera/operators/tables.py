"""Logits processors of your own, and models, as Arrow table functions for SQL.

    SELECT * FROM my_warp(TABLE(SELECT row_id, token_id, score FROM logits) PARTITION BY row_id)
    SELECT * FROM my_tokens(TABLE(SELECT doc_id AS row_id, split(text, ' ') AS pieces FROM documents))

A processor is a function of one row's scores, in order of token ids, and of the ids so far (none, if the table has no column `ids`). A row's part has
as many rows as the vocabulary has tokens, so it is held whole. Rows of pieces need no partitioning and are not shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf

from tessera.operators.subword import Model

Process = Callable[[np.ndarray, list[int]], np.ndarray]
#: Makers of processors by name.
PROCESSORS: dict[str, Callable[..., Process]] = {}

WARPED = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("token_id", T.LongType()), T.StructField("score", T.DoubleType())])
TOKENS = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("token", T.StringType()), T.StructField("id", T.LongType())])


def register(name: str):
    """Adds a maker of processors: its arguments are the processor's settings."""

    def add(make: Callable[..., Process]):
        PROCESSORS[name] = make
        return make

    return add


def processor(name: str, **settings: Any) -> Process:
    if name not in PROCESSORS:
        raise ValueError(f"unknown logits processor {name!r}")
    return PROCESSORS[name](**settings)


@register("epsilon_cutoff")
def epsilon_cutoff(epsilon: float) -> Process:
    """Tokens less probable than epsilon stay out, but for the most probable one."""
    if not 0 <= epsilon < 1:
        raise ValueError("epsilon must be between 0 and 1")

    def process(scores: np.ndarray, ids: list[int]) -> np.ndarray:
        p = np.exp(scores - scores.max())
        keep = p / p.sum() >= epsilon
        keep[np.argmax(scores)] = True
        return np.where(keep, scores, -np.inf)

    return process


@register("no_repeat_ngram")
def no_repeat_ngram(size: int) -> Process:
    """Tokens that would repeat a run of so many ids stay out."""
    if size < 1:
        raise ValueError("runs have at least one id")

    def process(scores: np.ndarray, ids: list[int]) -> np.ndarray:
        out = scores.copy()
        last = ids[len(ids) - size + 1 :] if size > 1 else []
        for i in range(len(ids) - size + 1):
            if ids[i : i + size - 1] == last and 0 <= ids[i + size - 1] < len(out):
                out[ids[i + size - 1]] = -np.inf
        return out

    return process


def _batch(rows: pa.RecordBatch | pa.StructArray, *names: str) -> pa.RecordBatch:
    """A table argument's rows, which must have these columns. (Arrow's table functions cannot look at their arguments before they run.)"""
    batch = rows if isinstance(rows, pa.RecordBatch) else pa.RecordBatch.from_struct_array(rows)
    missing = sorted(set(names) - set(batch.schema.names))
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return batch


def warp_function(process: Process) -> Any:
    """A table function of (row_id, token_id, score, perhaps ids), partitioned by row_id."""

    class Warp:
        def __init__(self):
            self.parts: list[pa.RecordBatch] = []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            self.parts.append(_batch(rows, "row_id", "token_id", "score"))
            yield from ()

        def terminate(self) -> Iterator[pa.Table]:
            if not self.parts:
                return
            rows = pa.Table.from_batches(self.parts).sort_by("token_id")
            if len(rows.column("row_id").unique()) > 1:
                raise ValueError("the table must be PARTITIONED BY row_id")
            ids = rows.column("ids")[0].as_py() or [] if "ids" in rows.column_names else []
            scores = np.asarray(process(rows.column("score").to_numpy().astype(np.float64), ids), dtype=np.float64)
            yield pa.table({"row_id": rows.column("row_id").cast(pa.int64()), "token_id": rows.column("token_id").cast(pa.int64()), "score": pa.array(scores)})

    return arrow_udtf(Warp, returnType=WARPED)


def tokens_function(model: Model) -> Any:
    """A table function of (row_id, pieces) that gives a row for each token: row_id, pos, token, id (null without one)."""

    class Tokens:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            batch = _batch(rows, "row_id", "pieces")
            pieces = batch.column("pieces")
            coded = pieces.flatten().dictionary_encode()
            known = model.many([x or "" for x in coded.dictionary.to_pylist()])
            place = coded.indices.to_pylist()
            at = 0
            out: dict[str, list] = {"row_id": [], "pos": [], "token": [], "id": []}
            for row, n in zip(batch.column("row_id").to_pylist(), pieces.value_lengths().to_pylist(), strict=True):
                found = [t for i in place[at : at + (n or 0)] if i is not None for t in known[i]]
                at += n or 0
                out["row_id"] += [row] * len(found)
                out["pos"] += range(len(found))
                out["token"] += found
            out["id"] = [model.id(t) for t in out["token"]]
            yield pa.table({"row_id": pa.array(out["row_id"], pa.int64()), "pos": pa.array(out["pos"], pa.int64()), "token": pa.array(out["token"], pa.string()), "id": pa.array(out["id"], pa.int64())})

    return arrow_udtf(Tokens, returnType=TOKENS)


def register_functions(spark: SparkSession, processors: dict[str, Process] | None = None, models: dict[str, Model] | None = None) -> None:
    """Table functions of these names, for SQL."""
    for name, process in (processors or {}).items():
        spark.udtf.register(name, warp_function(process))
    for name, model in (models or {}).items():
        spark.udtf.register(name, tokens_function(model))


def warp(process: Process) -> Callable[[DataFrame], DataFrame]:
    """A processor as a step of a plan of logits.apply, beside the windows."""
    return lambda df: warp_function(process)(df.asTable().partitionBy("row_id"))
