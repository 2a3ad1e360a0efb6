"""A language model's surface: its configuration, its tokenizer, and generation from ids or texts. The network itself is a function you give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.config import Config
from tessera.operators import generate
from tessera.operators.logits import GenerationConfig
from tessera.plans.tokenizer import Tokenizer, TokenizerError
from tessera.sources.files import read_model_folder
from tessera.streaming import tokens

#: Padded ids and their mask (None if the network takes none) to scores, a row for each place.
Network = Callable[[np.ndarray, "np.ndarray | None"], np.ndarray]


class Padded:
    """Scores of the next token from a network of one fixed length: ids padded to it, scores at the last real token."""

    def __init__(self, network: Network, length: int, pad_id: int | None = None, masked: bool = True):
        self.network, self.length, self.pad_id, self.masked = network, length, pad_id or 0, masked

    def __call__(self, ids: list[int]) -> np.ndarray:
        n = len(ids)
        if not 0 < n <= self.length:
            raise ValueError(f"{n} ids for a model of {self.length}")
        padded = np.full(self.length, self.pad_id, dtype=np.int64)
        padded[:n] = ids
        mask = (np.arange(self.length) < n).astype(np.int64) if self.masked else None
        return np.asarray(self.network(padded, mask))[n - 1]


@dataclass
class LanguageModel:
    """`scores` gives the next token's scores from the ids so far: a Padded, a generate.Stateful, or any function."""

    name: str
    scores: generate.Scores
    model_config: Config
    tokenizer_config: Config
    tokenizer_data: Config

    @staticmethod
    def from_folder(folder: str, scores: generate.Scores, name: str | None = None) -> LanguageModel:
        found = read_model_folder(folder)
        return LanguageModel(name or str(folder).rstrip("/").rsplit("/", 1)[-1], scores, found["config"], found["tokenizer_config"], found["tokenizer_data"])

    @property
    def model_type(self) -> str | None:
        return self.model_config.modelType.string()

    @property
    def text_generation_parameters(self) -> Config:
        """The task's settings; files name it with a hyphen."""
        tasks = self.model_config.taskSpecificParams
        return tasks.textGeneration if tasks["text-generation"].is_null else tasks["text-generation"]

    @property
    def default_do_sample(self) -> bool:
        return self.text_generation_parameters.doSample.boolean(True)

    @property
    def bos_token_id(self) -> int | None:
        return self.model_config.bosTokenId.integer()

    @property
    def eos_token_id(self) -> int | None:
        return self.model_config.eosTokenId.integer()

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Compiled at first use."""
        if self.tokenizer_config.is_null:
            raise TokenizerError("missing_config", self.name)
        return Tokenizer.compile(self.tokenizer_data, self.tokenizer_config)

    @property
    def default_generation_config(self) -> GenerationConfig:
        """2048 new tokens; models with gpt in their name sample from the 50 best."""
        config = GenerationConfig(max_length=1 << 30, max_new_tokens=2048, eos_token_id=self.eos_token_id)
        return replace(config, do_sample=True, top_k=50) if "gpt" in self.name.lower() else config

    def generate(self, prompts: DataFrame, config: GenerationConfig | None = None, **options) -> DataFrame:
        """(key, step, ids) of prompts (key, ids); options are those of generate.generate."""
        return generate.generate(prompts, self.scores, config or self.default_generation_config, **options)

    def stream(self, prompts: DataFrame, sink: Callable[[DataFrame, int], None], config: GenerationConfig | None = None, **options) -> StreamingQuery:
        """Starts a query over a stream of prompts (seq_id, ids), whose sink gets the next token of every open sequence in each micro-batch; options are
        those of tokens.stream_tokens."""
        return tokens.stream_tokens(prompts, self.scores, config or self.default_generation_config, sink, **options)

    def generate_text(self, prompts: DataFrame, config: GenerationConfig | None = None, max_new_tokens: int | None = None, **options) -> DataFrame:
        """(key, text) of prompts (key, text)."""
        config = config or self.default_generation_config
        most = config.max_new_tokens if max_new_tokens is None else max_new_tokens
        return generate.generate_text(prompts, self.tokenizer, self.scores, config, 2048 if most is None else most, **options)
