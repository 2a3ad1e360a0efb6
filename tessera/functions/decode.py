"""Decoders, array of tokens to array of strings, all native. `decoder(config, added)` compiles one by its type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as t
from tessera.functions.normalize import replace as _replace
from tessera.functions.pretokenize import scheme_of

Decode = Callable[[Column], Column]
_REGISTRY: dict[str, Callable[[Config, tuple[str, ...]], Decode]] = {}

#: Literal replacements of the clean-up, in order.
CLEAN_UP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))


def register(name: str):
    def add(make: Callable[[Config, tuple[str, ...]], Decode]):
        _REGISTRY[name] = make
        return make

    return add


def decoder(config: Config | dict | None, added: tuple[str, ...] = ()) -> Decode:
    config = Config.of(config)
    if config.is_null:
        return lambda tokens: tokens
    kind = config.type.string()
    if kind not in _REGISTRY:
        raise ValueError(f"unknown decoder {kind!r}")
    return _REGISTRY[kind](config, added)


def clean_up(c: Column) -> Column:
    for old, new in CLEAN_UP:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def wordpiece(tokens: Column, prefix: str = "##", cleanup: bool = False) -> Column:
    """The first token as it is; others lose the prefix, or gain a space. Of no tokens, none."""

    def clean(x: Column) -> Column:
        if not cleanup:
            return x
        pattern = rf"[{t.SPACE}](\.|\?|!|,|'[{t.SPACE}]|n't|'m|'s|'ve|'re)"
        return F.replace(F.regexp_replace(x, pattern, "$1"), F.lit(" do not"), F.lit(" don't"))

    def one(x: Column, i: Column) -> Column:
        rest = F.when(x.startswith(prefix), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(F.concat(F.lit(" "), x))
        return clean(F.when(i == 0, x).otherwise(rest))

    return F.transform(tokens, one)


def _runs(tokens: Column, alone: Callable[[Column], Column], finish: Callable[[Column], Column], flush: bool) -> Column:
    """Tokens that stand alone as they are, runs of the others joined and finished."""
    zero = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def closed(s: Column) -> Column:
        return F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(finish(s["held"]))))

    def step(s: Column, x: Column) -> Column:
        kept = F.struct(F.lit("").alias("held"), F.concat(closed(s), F.array(x)).alias("out"))
        more = F.struct(F.concat(s["held"], x).alias("held"), s["out"].alias("out"))
        return F.when(alone(x), kept).otherwise(more)

    return F.aggregate(tokens, zero, step, (lambda s: closed(s)) if flush else (lambda s: s["out"]))


def byte_level(tokens: Column, added: tuple[str, ...] = ()) -> Column:
    """Runs between added tokens, their characters back as bytes; invalid UTF-8 becomes U+FFFD."""
    if not added:
        return F.when(F.size(tokens) > 0, F.array(t.from_bytes(F.array_join(tokens, "")))).otherwise(F.array().cast("array<string>"))
    return _runs(tokens, lambda x: x.isin(*added), t.from_bytes, True)


def byte_fallback(tokens: Column, flush_tail: bool = False) -> Column:
    """Runs of <0xNN> as the text of their bytes. A run at the end is lost unless flush_tail is set."""
    is_byte = r"^<0x[0-9A-Fa-f]{2}>$"
    text = lambda held: F.make_valid_utf8(F.unhex(F.regexp_replace(held, "<0x|>", "")).cast("string"))
    return _runs(tokens, lambda x: ~x.rlike(is_byte), text, flush_tail)


def fuse(tokens: Column) -> Column:
    return F.array(F.array_join(tokens, ""))


def strip(tokens: Column, start: int, stop: int) -> Column:
    """Up to so many spaces off each token's ends."""
    return F.transform(tokens, lambda x: F.regexp_replace(F.regexp_replace(x, f"^ {{0,{start}}}", ""), f" {{0,{stop}}}$", ""))


def replace(tokens: Column, content: str, literal: str | None = None, pattern: str | None = None) -> Column:
    return _replace(content, literal, pattern).array(tokens)


def metaspace(tokens: Column, mark: str = "_", scheme: str = "always") -> Column:
    """Marks become spaces; the first token loses one at its front unless the scheme is never."""

    def one(x: Column, i: Column) -> Column:
        y = F.replace(x, F.lit(mark), F.lit(" "))
        return y if scheme == "never" else F.when((i == 0) & y.startswith(" "), F.substring(y, 2, 1 << 30)).otherwise(y)

    return F.transform(tokens, one)


@register("Sequence")
def _sequence(c: Config, added: tuple[str, ...]) -> Decode:
    children = [decoder(x, added) for x in c.decoders.array()]

    def run(tokens: Column) -> Column:
        for child in children:
            tokens = child(tokens)
        return tokens

    return run


@register("WordPiece")
def _wordpiece(c: Config, added: tuple[str, ...]) -> Decode:
    return lambda x: wordpiece(x, c["prefix"].string("##"), c.cleanup.boolean(False))


@register("ByteLevel")
def _byte_level(c: Config, added: tuple[str, ...]) -> Decode:
    return lambda x: byte_level(x, added)


@register("Replace")
def _replace_type(c: Config, added: tuple[str, ...]) -> Decode:
    return lambda x: replace(x, c.content.string(""), c.pattern["String"].string(), c.pattern["Regex"].string())


@register("ByteFallback")
def _byte_fallback(c: Config, added: tuple[str, ...]) -> Decode:
    return lambda x: byte_fallback(x, c.flushTail.boolean(False))


@register("Fuse")
def _fuse(c: Config, added: tuple[str, ...]) -> Decode:
    return fuse


@register("Strip")
def _strip(c: Config, added: tuple[str, ...]) -> Decode:
    return lambda x: strip(x, c.start.integer(0), c.stop.integer(0))


@register("Metaspace")
def _metaspace(c: Config, added: tuple[str, ...]) -> Decode:
    return lambda x: metaspace(x, c.replacement.string("_"), scheme_of(c))
