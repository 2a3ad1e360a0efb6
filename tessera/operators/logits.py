"""Logits processors as windows over a long table (row_id, token_id, score), and the plan that orders them.

A filtered token keeps its row, with a score of minus infinity. Windows are partitioned by row_id: a row has as many entries
as the vocabulary has tokens, which is fixed, so no partition grows with the data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

NEGATIVE = float("-inf")
Warp = Callable[[DataFrame], DataFrame]


def row() -> WindowSpec:
    return Window.partitionBy("row_id")


def by_score() -> WindowSpec:
    return row().orderBy(F.desc("score"), "token_id")


def _filtered(keep: Column, value: float) -> Column:
    return F.when(keep, F.col("score")).otherwise(F.lit(value))


def softmax(score: str = "score") -> Column:
    e = F.exp(F.col(score) - F.max(score).over(row()))
    return e / F.sum(e).over(row())


def temperature(t: float) -> Warp:
    if not t > 0:
        raise ValueError("the temperature must be positive")
    return lambda df: df.withColumn("score", F.col("score") / F.lit(t))


def top_k(k: int, value: float = NEGATIVE, min_keep: int = 1) -> Warp:
    """Scores below the k-th stay out; those that equal it stay in."""
    if k <= 0:
        raise ValueError("k must be positive")
    k = max(k, min_keep)
    return lambda df: df.withColumn("score", _filtered(F.rank().over(row().orderBy(F.desc("score"))) <= k, value))


def _with_p(df: DataFrame) -> DataFrame:
    return df.withColumn("__p", softmax())


def top_p(p: float, value: float = NEGATIVE, min_keep: int = 1) -> Warp:
    """From the most probable token on, those before which less than p (or exactly p) has been summed up."""
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    if min_keep < 1:
        raise ValueError("min_keep must be positive")

    def warp(df: DataFrame) -> DataFrame:
        before = F.sum("__p").over(by_score().rowsBetween(Window.unboundedPreceding, 0)) - F.col("__p")
        keep = (before <= p) | (F.row_number().over(by_score()) <= min_keep)
        return _with_p(df).withColumn("score", _filtered(keep, value)).drop("__p")

    return warp


def min_p(p: float, value: float = NEGATIVE, min_keep: int = 1) -> Warp:
    """Tokens at least p times as probable as the most probable one, and the first min_keep."""
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    if min_keep < 1:
        raise ValueError("min_keep must be positive")

    def warp(df: DataFrame) -> DataFrame:
        keep = (F.col("__p") >= p * F.max("__p").over(row())) | (F.row_number().over(by_score()) <= min_keep)
        return _with_p(df).withColumn("score", _filtered(keep, value)).drop("__p")

    return warp


def repetition(penalty: float, inputs: DataFrame) -> Warp:
    """Tokens among a row's inputs (row_id, token_id): negative scores times the penalty, others divided by it, once each."""
    if not penalty > 0:
        raise ValueError("the penalty must be positive")
    if penalty == 1:
        return lambda df: df

    def warp(df: DataFrame) -> DataFrame:
        seen = inputs.select("row_id", "token_id").distinct().withColumn("__seen", F.lit(True))
        changed = F.when(F.col("score") < 0, F.col("score") * penalty).otherwise(F.col("score") / penalty)
        return df.join(seen, ["row_id", "token_id"], "left").withColumn("score", F.when(F.col("__seen"), changed).otherwise(F.col("score"))).drop("__seen")

    return warp


def apply(df: DataFrame, warps: list[Warp]) -> DataFrame:
    for w in warps:
        df = w(df)
    return df


@dataclass(frozen=True)
class GenerationConfig:
    max_length: int = 20
    max_new_tokens: int | None = None
    do_sample: bool = False
    num_beams: int = 1
    num_beam_groups: int = 1
    penalty_alpha: float | None = None
    temperature: float = 1.0
    top_k: int = 50
    top_p: float = 1.0
    min_p: float | None = None
    repetition_penalty: float = 1.0
    pad_token_id: int | None = None
    bos_token_id: int | None = None
    eos_token_id: int | None = None

    @property
    def mode(self) -> str:
        if self.top_k > 1 and not self.do_sample and (self.penalty_alpha or 0) > 0:
            return "contrastive_search"
        if self.num_beams == 1 and self.num_beam_groups == 1:
            return "sample" if self.do_sample else "greedy"
        if self.num_beams >= 2 and self.num_beam_groups == 1:
            return "unsupported" if self.do_sample else "beam"
        return "group_beam" if self.num_beams >= 2 and self.num_beam_groups >= 2 else "unsupported"


def mode(beams: Column, groups: Column, sample: Column, k: Column, alpha: Column) -> Column:
    """The mode of each row's settings."""
    one = (beams == 1) & (groups == 1)
    return (
        F.when((k > 1) & ~sample & (F.coalesce(alpha, F.lit(0)) > 0), "contrastive_search")
        .when(one & ~sample, "greedy")
        .when(one & sample, "sample")
        .when((beams >= 2) & (groups == 1) & ~sample, "beam")
        .when((beams >= 2) & (groups >= 2), "group_beam")
        .otherwise("unsupported")
    )


def plan(config: GenerationConfig, inputs: DataFrame | None = None) -> list[Warp]:
    """Repetition penalty, temperature, top-k, top-p and min-p, without those that change nothing."""
    out = [repetition(config.repetition_penalty, inputs)] if config.repetition_penalty != 1 and inputs is not None else []
    out += [temperature(config.temperature)] if config.temperature > 0 and config.temperature != 1 else []
    out += [top_k(config.top_k)] if 0 < config.top_k < (1 << 31) - 1 else []
    out += [top_p(config.top_p)] if config.top_p < 1 else []
    return out + ([min_p(config.min_p)] if config.min_p is not None else [])


def greedy(df: DataFrame) -> DataFrame:
    """(row_id, token_id) of the greatest score; of equal ones the least id."""
    best = F.max_by("token_id", F.struct("score", -F.col("token_id")))
    return df.groupBy("row_id").agg(best.alias("token_id"))


def sample(df: DataFrame, u: Column | None = None, seed: int = 0) -> DataFrame:
    """(row_id, token_id): the first token, in order of ids, up to which the probabilities reach u; if none does, the first."""
    if u is None:
        u = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    in_order = row().orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_p(df.withColumn("__u", u)).withColumn("__sum", F.sum("__p").over(in_order))
    hit = F.min(F.when(F.col("__sum") >= F.col("__u"), F.col("token_id")))
    return rows.groupBy("row_id").agg(F.coalesce(hit, F.min("token_id")).alias("token_id"))
