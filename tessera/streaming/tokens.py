"""Generated tokens as a stream, one at a time: each open sequence is keyed state, and a timer takes it a token further in every micro-batch.

So all sequences advance side by side, and a sink sees the first token of each before the second of any. A sequence may come in parts, also
in different micro-batches; its tokens follow the last part. Ids are a list that only grows. A model with a cache keeps an entry for each
place in a map, so a step reads the cache and writes one entry. State goes when a sequence ends, and after a time when nothing comes for it. What was
emitted before a loss is not computed again: ids, cache and the place in the random numbers are in the checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.operators.generate import Scores, choose
from tessera.operators.logits import GenerationConfig

#: Milliseconds after which a sequence's state goes if no part and no token came.
FORGET = 24 * 3600 * 1000

OUTPUT = "seq_id long, step int, token_id long, ids array<long>"


class Cached(Protocol):
    """A model that reads one token at a time: its scores for the next one, and an entry that later steps get with those of all places before."""

    def step(self, token: int, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


def cached_scores(model: Cached) -> Scores:
    """The same model without memory: it reads all ids at every call."""

    def scores(ids: list[int]) -> np.ndarray:
        past: list[np.ndarray] = []
        out = np.empty(0)
        for i in ids:
            out, entry = model.step(i, np.array(past))
            past.append(np.asarray(entry, dtype=np.float64))
        return out

    return scores


class _Decoder(StatefulProcessor):
    def __init__(self, model: Scores | Cached, config: GenerationConfig, seed: int, forget: int):
        self.model, self.config, self.seed, self.forget = model, config, seed, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "prompt int, step int, open boolean, scores array<double>, timer bigint", self.forget)
        self.ids = handle.getListState("ids", "id bigint", self.forget)
        self.cache = handle.getMapState("cache", T.StructType([T.StructField("place", T.IntegerType())]), T.StructType([T.StructField("entry", T.ArrayType(T.DoubleType()))]), self.forget)

    def _ids(self) -> list[int]:
        return [int(r[0]) for r in self.ids.get()] if self.ids.exists() else []

    def _read(self, new: list[int], ids: list[int]) -> list[float]:
        """The scores after `new`, the last of all ids."""
        if not hasattr(self.model, "step"):
            return [float(x) for x in self.model(ids)]
        kept = {int(k[0]): np.array(v[0], dtype=np.float64) for k, v in self.cache.iterator()} if len(ids) > len(new) and self.cache.exists() else {}
        past = [kept[i] for i in range(len(ids) - len(new))]
        out = np.empty(0)
        for i, token in enumerate(new, len(ids) - len(new)):
            out, entry = self.model.step(token, np.array(past))
            past.append(np.asarray(entry, dtype=np.float64))
            self.cache.updateValue((i,), ([float(x) for x in past[-1]],))
        return [float(x) for x in out]

    def _wait(self, timer, old: int | None) -> int:
        if old is not None:
            self.handle.deleteTimer(old)
        due = timer.getCurrentProcessingTimeInMs() + 1
        self.handle.registerTimer(due)
        return due

    def _forget(self) -> None:
        for state in (self.about, self.ids, self.cache):
            state.clear()

    def _add(self, timer, new: list[int], last: bool) -> None:
        known = self.about.get() if self.about.exists() else (0, 0, False, None, None)
        ids = self._ids() + new
        if new:
            self.ids.appendList([(i,) for i in new])
        # a model with a cache reads each part as it comes, others once the prompt is whole
        scores = self._read(new, ids) if new and (last or hasattr(self.model, "step")) else known[3]
        if last and not new and not hasattr(self.model, "step"):
            scores = [float(x) for x in self.model(ids)]
        self.about.update((len(ids), 0, last, scores, self._wait(timer, known[4]) if last else None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows)).sort_values("part", kind="stable")
        for ids, last in zip(parts["ids"], parts["last"], strict=True):
            if self.about.exists() and self.about.get()[2]:
                break  # a prompt that is whole takes no more parts
            self._add(timerValues, [int(i) for i in ids] if ids is not None else [], bool(last))
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for ids in initialState["ids"]:
            self._add(timerValues, [int(i) for i in ids], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.about.exists():
            self._forget()  # only a timer outlived the time
            return iter(())
        prompt, step, _, scores, _ = self.about.get()
        ids = self._ids()
        token = choose(np.array(scores), ids, self.config, prompt, lambda: self._uniform(key[0], step)) if scores is not None else None
        if token is None:
            self._forget()
            return iter(())
        ids.append(token)
        self.ids.appendValue((token,))
        self.about.update((prompt, step + 1, True, self._read([token], ids), self._wait(timerValues, None)))
        return iter([pd.DataFrame({"seq_id": [key[0]], "step": [step + 1], "token_id": [token], "ids": [ids]})])

    def _uniform(self, key: int, step: int) -> float:
        """The number that a generator of the sequence's own gives at this step."""
        bits = np.random.default_rng([self.seed, int(key) & 0xFFFFFFFF])
        bits.bit_generator.advance(step)
        return bits.random()

    def close(self) -> None:
        pass


def tokens(prompts: DataFrame, model: Scores | Cached, config: GenerationConfig, seed: int = 0, resumed: DataFrame | None = None, forget_ms: int = FORGET) -> DataFrame:
    """A stream (seq_id, step, token_id, ids so far) of a stream of prompts (seq_id, ids), which may have `part` (int) and `last` (boolean: whether the prompt is whole). Sequences
    of a table `resumed` (seq_id, ids) go on with the first micro-batch. Needs the RocksDB state store."""
    if config.mode not in ("greedy", "sample"):
        raise ValueError(f"the mode {config.mode} is not supported")
    part = F.col("part") if "part" in prompts.columns else F.lit(0)
    last = F.coalesce("last", F.lit(False)) if "last" in prompts.columns else F.lit(True)
    rows = prompts.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("ids").cast("array<long>").alias("ids"), part.cast("int").alias("part"), last.alias("last"))
    start = None if resumed is None else resumed.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("ids").cast("array<long>").alias("ids")).groupBy("seq_id")
    return rows.groupBy("seq_id").transformWithStateInPandas(_Decoder(model, config, seed, forget_ms), OUTPUT, "Append", "ProcessingTime", initialState=start)


def stream_tokens(prompts: DataFrame, model: Scores | Cached, config: GenerationConfig, sink: Callable[[DataFrame, int], None], tokenizer=None, checkpoint: str | None = None, **options) -> StreamingQuery:
    """Starts a query over a stream of prompts. In each micro-batch the sink gets the next token of every open sequence, (seq_id, step, token_id, ids) and, with a
    tokenizer, text; options are those of `tokens`."""
    rows = tokens(prompts, model, config, **options)
    if tokenizer is not None:
        rows = rows.withColumn("text", tokenizer.decode(F.col("ids")))
    writer = rows.writeStream.outputMode("append").foreachBatch(sink)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
