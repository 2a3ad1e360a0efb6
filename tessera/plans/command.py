"""The command line: text of prompts, token by token as it comes, or of a table of prompts.

    python -m tessera FOLDER MODULE:FUNCTION --prompt "..." [--prompt ...]
    python -m tessera FOLDER MODULE:FUNCTION --prompts IN.parquet --output OUT.parquet

FOLDER has a model's configuration and tokenizer, the function gives scores of the next token from the ids so far. Prompts of the command line are a stream
whose new text is printed in each micro-batch; a table (seq_id, text) is generated and written by Spark's tasks, nothing of it is printed."""

from __future__ import annotations

import argparse
import importlib
import sys
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessera.operators import generate
from tessera.operators.logits import GenerationConfig
from tessera.plans.language_model import LanguageModel
from tessera.sources.scratch import folder
from tessera.streaming import tokens


@dataclass
class Rates:
    """Tokens of a run, seconds until the first came, and those after it."""

    tokens: int = 0
    prefill: float = 0.0
    later: int = 0
    decoding: float = 0.0

    @property
    def per_second(self) -> float:
        """Tokens after those of the first step, a second."""
        return self.later / self.decoding if self.decoding else 0.0

    def __str__(self) -> str:
        return f"{self.tokens} tokens, {self.per_second:.2f} tokens/s, prefill {self.prefill:.2f} s"


class _Counter(StreamingQueryListener):
    """Adds up what a query observed of its micro-batches."""

    def __init__(self, name: str):
        self.name, self.batches, self.ended = name, [], threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name and "tokens" in event.progress.observedMetrics:
            self.batches.append(int(event.progress.observedMetrics["tokens"]["n"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def run(spark: SparkSession, model: LanguageModel, prompts: list[str], config: GenerationConfig, write: Callable[[str], None], seed: int = 0, seconds: float = 3600) -> Rates:
    """Writes the text of prompts as it grows: each new piece, with the prompt's number if there are several. Returns the rates that the query's listener observed."""
    place = f"{folder(spark)}/prompts-{uuid.uuid4().hex}"
    given = spark.createDataFrame(list(enumerate(prompts)), "seq_id long, text string")
    given.select("seq_id", model.tokenizer.encode(F.col("text")).alias("ids")).write.parquet(f"{place}/in")
    known = {i: "" for i in range(len(prompts))}
    rates, done = Rates(), threading.Event()
    began = time.monotonic()
    last = began

    def sink(rows: DataFrame, batch: int) -> None:
        nonlocal last
        if done.is_set():
            return
        # each open sequence gets a token in each micro-batch after the first, which reads the prompts
        found = rows.select("seq_id", generate.show(model.tokenizer.decode(F.col("ids"))).alias("text")).collect()
        now = time.monotonic()
        for seq, text in sorted(found):
            # a character whose bytes are not all there is written when they are
            text = text.rstrip("�")
            if text.startswith(known[seq]) and len(text) > len(known[seq]):
                new = text[len(known[seq]) :]
                write(new if len(prompts) == 1 else f"[{seq}] {new}\n")
                known[seq] = text
        if found and not rates.prefill:
            rates.prefill = now - began
            last = now
        elif found:
            rates.decoding += now - last
            last = now
        if batch and not found:
            done.set()

    counter = _Counter(place.rsplit("/", 1)[-1])
    spark.streams.addListener(counter)
    try:
        stream = spark.readStream.schema("seq_id long, ids array<long>").parquet(f"{place}/in")
        made = tokens.tokens(stream, model.scores, config, seed).observe("tokens", F.count("*").alias("n"))
        query = made.writeStream.queryName(counter.name).outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{place}/state").start()
        end = time.monotonic() + seconds
        while query.isActive and not done.wait(0.05) and time.monotonic() < end:
            pass
        if query.exception() is not None:
            raise query.exception()
        query.stop()
        if not done.is_set():
            raise TimeoutError(f"not at the end after {seconds} s")
        counter.ended.wait(30)
    finally:
        spark.streams.removeListener(counter)
    came = [n for n in counter.batches if n]
    rates.tokens, rates.later = sum(came), sum(came[1:])
    return rates


def settings(args: argparse.Namespace, model: LanguageModel) -> GenerationConfig:
    given = {"temperature": args.temperature, "top_k": args.top_k, "top_p": args.top_p, "min_p": args.min_p, "repetition_penalty": args.repetition_penalty}
    config = replace(model.default_generation_config, max_new_tokens=args.max_new_tokens, **{k: v for k, v in given.items() if v is not None})
    return config if args.sample is None else replace(config, do_sample=args.sample)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tessera", description="Generates text after prompts.")
    p.add_argument("folder", help="configuration and tokenizer of a model")
    p.add_argument("scores", help="module:function that gives the next token's scores from ids")
    p.add_argument("--prompt", action="append", default=[])
    p.add_argument("--prompts", help="Parquet table of seq_id and text")
    p.add_argument("--output", help="folder for the table of seq_id and text that is made of --prompts")
    p.add_argument("--max-new-tokens", type=int, default=128)
    p.add_argument("--sample", action=argparse.BooleanOptionalAction, default=None)
    for name, kind in (("temperature", float), ("top-k", int), ("top-p", float), ("min-p", float), ("repetition-penalty", float)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--seed", type=int, default=0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, write: Callable[[str], None] | None = None) -> None:
    p = parser()
    args = p.parse_args(argv)
    if bool(args.prompt) == bool(args.prompts) or bool(args.prompts) != bool(args.output):
        p.error("either --prompt, or --prompts and --output")
    write = write or (lambda text: print(text, end="", flush=True))
    module, _, name = args.scores.partition(":")
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    model = LanguageModel.from_folder(args.folder, getattr(importlib.import_module(module), name))
    config = settings(args, model)
    if args.prompts:
        model.generate_text(spark.read.parquet(args.prompts), config, args.max_new_tokens).write.parquet(args.output)
        return
    # transformWithState needs it
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rates = run(spark, model, args.prompt, config, write, args.seed)
    write("\n")
    print(rates, file=sys.stderr)
