"""Generation: sequences are rows, so the token loop runs inside one UDF call for each; the model is a function you give.

`model(ids) -> scores` gets the ids so far. `batch_model` forms get a state, for models that keep one per sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.logits import GenerationConfig
from tessera.sources.scratch import cut

Scores = Callable[[list[int]], np.ndarray]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def process(scores: np.ndarray, ids: list[int], config: GenerationConfig) -> np.ndarray:
    """One row's scores through the processors, in the order of the plan."""
    x = np.array(scores, dtype=np.float64)
    if config.repetition_penalty != 1:
        seen = [i for i in set(ids) if 0 <= i < len(x)]
        x[seen] = np.where(x[seen] < 0, x[seen] * config.repetition_penalty, x[seen] / config.repetition_penalty)
    if config.temperature not in (0, 1):
        x = x / config.temperature
    if 0 < config.top_k < len(x):
        x[x < np.sort(x)[-config.top_k]] = -np.inf
    order = np.lexsort((np.arange(len(x)), -x))
    if config.top_p < 1:
        p = _softmax(x)[order]
        drop = np.cumsum(p) - p > config.top_p
        drop[:1] = False
        x[order[drop]] = -np.inf
    if config.min_p is not None:
        p = _softmax(x)
        drop = p < config.min_p * p.max()
        drop[order[:1]] = False
        x[drop] = -np.inf
    return x


def choose(scores: np.ndarray, ids: list[int], config: GenerationConfig, prompt: int, uniform: Callable[[], float] | None = None) -> int | None:
    """The next token after ids, the first `prompt` of which were given; None at max_length (or so many new tokens) and for the end token."""
    limit = config.max_length if config.max_new_tokens is None else min(config.max_length, prompt + config.max_new_tokens)
    if len(ids) >= limit:
        return None
    x = process(scores, ids, config)
    new = int(np.argmax(x if config.mode == "greedy" else np.cumsum(_softmax(x)) >= uniform()))
    return None if new == config.eos_token_id else new


def steps(model: Scores, ids: list[int], config: GenerationConfig, uniform: Callable[[], float] | None = None) -> Iterator[list[int]]:
    """The sequence after each new token. Ends at max_length (or so many new tokens) and before an end token."""
    if config.mode not in ("greedy", "sample"):
        raise ValueError(f"the mode {config.mode} is not supported")
    ids = list(ids)
    prompt = len(ids)
    limit = config.max_length if config.max_new_tokens is None else min(config.max_length, prompt + config.max_new_tokens)
    while len(ids) < limit and (new := choose(model(ids), ids, config, prompt, uniform)) is not None:
        ids.append(new)
        yield list(ids)


def generate(prompts: DataFrame, model: Scores, config: GenerationConfig, ids: str = "ids", key: str = "seq_id", seed: int = 0, every_step: bool = False) -> DataFrame:
    """(key, step, ids): the whole sequence, or a row after each token."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, start in zip(f[key], f[ids], strict=True):
                rng = np.random.default_rng([seed, int(k) & 0xFFFFFFFF])
                last, n = list(start), 0
                for last in steps(model, list(start), config, rng.random):
                    n += 1
                    if every_step:
                        out.append((k, n, last))
                if not every_step:
                    out.append((k, n, last))
            yield pd.DataFrame(out, columns=[key, "step", "ids"])

    return prompts.select(key, ids).mapInPandas(run, f"{key} long, step int, ids array<long>")


def generate_text(prompts: DataFrame, tokenizer, model: Scores, config: GenerationConfig, max_new_tokens: int, text: str = "text", key: str = "seq_id") -> DataFrame:
    """(key, text): prompts encoded, continued and decoded as a whole, with the tokenizer's end token."""
    from dataclasses import replace

    eos = tokenizer.token_id("eos_token")
    config = replace(config, max_new_tokens=max_new_tokens, max_length=1 << 30, eos_token_id=config.eos_token_id if eos is None else eos)
    done = generate(prompts.select(key, tokenizer.encode(F.col(text)).alias("ids")), model, config, key=key)
    return done.select(key, tokenizer.decode(F.col("ids")).alias("text"))


def paths(transitions: DataFrame, n_steps: int, token: str = "token_id", eos_token_id: int | None = None) -> DataFrame:
    """(token, path): the tokens that follow each token of a table (token, next_id), at most n_steps, up to the end token or one without a row. The
    table of 2 k steps is that of k joined with itself at the last token, so there are log2(n_steps) joins, each of a table that is written."""
    if n_steps < 1:
        raise ValueError("at least one step")
    now = transitions.where(F.col("next_id").isNotNull() & (F.lit(True) if eos_token_id is None else F.col("next_id") != eos_token_id))
    now, k = cut(now.select(F.col(token), F.array(F.col("next_id").cast("long")).alias("path"))), 1
    while k < n_steps:
        on = now.select(F.col(token).alias("__last"), F.col("path").alias("__more"))
        # a path that is shorter than k has ended, and ends here too
        last = F.when(F.size("path") == k, F.element_at("path", -1))
        longer = now.join(on, last == F.col("__last"), "left").select(token, F.slice(F.concat("path", F.coalesce("__more", F.array().cast("array<long>"))), 1, n_steps).alias("path"))
        now, k = cut(longer), 2 * k
    return now


def follow(prompts: DataFrame, transitions: DataFrame, n_steps: int, key: str = "seq_id", token: str = "token_id", eos_token_id: int | None = None) -> DataFrame:
    """Greedy generation with a table (token_id, next_id) as model: rows (key, step, token) for all steps from 0, the prompt's own token."""
    found = prompts.select(key, token).join(paths(transitions, n_steps, token, eos_token_id), token, "left")
    steps_ = F.posexplode(F.concat(F.array(F.col(token).cast("long")), F.coalesce("path", F.array().cast("array<long>"))))
    return found.select(key, steps_.alias("step", token))


def pad(ids: Column, length: int, pad_id: int | None = None) -> tuple[Column, Column]:
    """Ids filled up to a length, and the mask of real ones."""
    n = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    mask = F.concat(F.transform(ids, lambda x: F.lit(1)), F.array_repeat(F.lit(0), n))
    return F.concat(ids, F.array_repeat(F.lit(pad_id or 0).cast("long"), n)), mask


def causal_mask(n: int) -> np.ndarray:
    """The mask of one new token after n others: all zeros."""
    return np.zeros((1, 1, 1, n + 1), dtype=np.float16)


class Stateful:
    """A model that keeps state: the first call gets all ids, later ones only the last. `reset` before each sequence."""

    def __init__(self, make_state: Callable[[], object], call: Callable[[list[int], object], tuple[np.ndarray, object]]):
        self.make_state, self.call = make_state, call
        self.reset()

    def reset(self) -> None:
        self.state, self.n = self.make_state(), 0

    def __call__(self, ids: list[int]) -> np.ndarray:
        if len(ids) <= self.n:
            self.reset()
        scores, self.state = self.call(ids if not self.n else ids[self.n :], self.state)
        self.n = len(ids)
        return scores


def default_config(name: Column) -> Column:
    """Settings by a model's name: 2048 new tokens; names with gpt sample from the 50 best."""
    gpt = F.lower(name).contains("gpt")
    return F.struct(F.lit(2048).alias("max_new_tokens"), gpt.alias("do_sample"), F.lit(50).alias("top_k"))


def show(text: Column) -> Column:
    """Text of a command line: \\n as line feeds, without <s> and </s>."""
    out = F.replace(text, F.lit("\\n"), F.lit("\n"))
    for mark in ("<s>", "</s>"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out
