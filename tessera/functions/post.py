"""Post-processors, arrays of tokens to one array, all native. `postprocessor(config)` compiles f(tokens, pair, add_special)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import BLANK, WHITE_SPACE

Post = Callable[[Column, Column | None, bool], Column]
_REGISTRY: dict[str, Callable[[Config], Post]] = {}


def register(name: str):
    def add(make: Callable[[Config], Post]):
        _REGISTRY[name] = make
        return make

    return add


def postprocessor(config: Config | dict | None) -> Post:
    config = Config.of(config)
    if config.is_null:
        return lambda tokens, pair=None, add_special=True: tokens
    kind = config.type.string()
    if kind not in _REGISTRY:
        raise ValueError(f"unknown post-processor {kind!r}")
    return _REGISTRY[kind](config)


def on_ids(config: Config | dict | None, id_of: Callable[[str], int | None]) -> Post | None:
    """The same for arrays of ids, if the post-processor only adds tokens that have one; else None."""
    config = Config.of(config)
    if config.is_null:
        return postprocessor(config)
    one = lambda token: F.array(F.lit(id_of(token)).cast("long"))

    kind = config.type.string()
    if _REGISTRY.get(kind) is _byte_level:
        return postprocessor(config)
    if _REGISTRY.get(kind) is _template:
        single, pair = _items(config.single), _items(config.pair)
        names = [x for k, x in single + pair if k == "special"]
        made = template(single, pair, one)
    elif _REGISTRY.get(kind) is _bert:
        names = [config.cls.token()[1], config.sep.token()[1]]
        made = bert(*names, one)
    else:
        return None
    return None if any(id_of(x) is None for x in names) else made


def _one(token: str) -> Column:
    return F.array(F.lit(token))


def template(single: list[tuple[str, str]], pair: list[tuple[str, str]], one: Callable[[str], Column] = _one) -> Post:
    """Items are ("special", token), ("A", "") or ("B", ""); the pair's template holds if there is a pair."""

    def post(tokens: Column, other: Column | None = None, add_special: bool = True) -> Column:
        parts = []
        for kind, token in single if other is None else pair:
            if kind == "special":
                parts += [one(token)] if add_special else []
            elif kind == "A":
                parts.append(tokens)
            elif other is not None:
                parts.append(other)
        return F.concat(*parts) if parts else F.slice(tokens, 1, 0)

    return post


def bert(cls: str, sep: str, one: Callable[[str], Column] = _one) -> Post:
    def post(tokens: Column, other: Column | None = None, add_special: bool = True) -> Column:
        if not add_special:
            return tokens if other is None else F.concat(tokens, other)
        out = F.concat(one(cls), tokens, one(sep))
        return out if other is None else F.when(F.size(other) > 0, F.concat(out, other, one(sep))).otherwise(out)

    return post


def roberta(cls: str, sep: str, trim: bool = True, prefix_space: bool = True) -> Post:
    """Special tokens are added whatever the flag says. Trimming leaves one white space on each side with `prefix_space`; else none, but keeps line feeds."""

    def trimmed(tokens: Column) -> Column:
        if not trim:
            return tokens
        if prefix_space:
            return F.transform(tokens, lambda x: F.regexp_replace(F.regexp_replace(x, rf"^[{WHITE_SPACE}]*([{WHITE_SPACE}])", "$1"), rf"([{WHITE_SPACE}])[{WHITE_SPACE}]*\z", "$1"))
        return F.transform(tokens, lambda x: F.regexp_replace(x, rf"^[{BLANK}]+|[{BLANK}]+\z", ""))

    def post(tokens: Column, other: Column | None = None, add_special: bool = True) -> Column:
        out = F.concat(_one(cls), trimmed(tokens), _one(sep))
        return out if other is None else F.when(F.size(other) > 0, F.concat(out, _one(sep), trimmed(other), _one(sep))).otherwise(out)

    return post


@register("TemplateProcessing")
def _template(c: Config) -> Post:
    return template(_items(c.single), _items(c.pair))


def _items(part: Config) -> list[tuple[str, str]]:
    out = []
    for x in part.array():
        if not x["SpecialToken"].is_null:
            out.append(("special", x["SpecialToken"].id.string("")))
        elif not x["Sequence"].is_null:
            out.append((x["Sequence"].id.string("A"), ""))
    return out


@register("ByteLevel")
def _byte_level(c: Config) -> Post:
    """Tokens as they are; a pair is dropped."""
    return lambda tokens, other=None, add_special=True: tokens


@register("RobertaProcessing")
def _roberta(c: Config) -> Post:
    """Reads trim_offset; the key trim_offsets has no effect."""
    return roberta(c.cls.token()[1], c.sep.token()[1], c["trim_offset"].boolean(True), c.addPrefixSpace.boolean(True))


@register("BertProcessing")
def _bert(c: Config) -> Post:
    return bert(c.cls.token()[1], c.sep.token()[1])


@register("Sequence")
def _sequence(c: Config) -> Post:
    children = [postprocessor(x) for x in c.processors.array()]

    def post(tokens: Column, other: Column | None = None, add_special: bool = True) -> Column:
        for child in children:
            tokens, other = child(tokens, other, add_special), None
        return tokens

    return post
