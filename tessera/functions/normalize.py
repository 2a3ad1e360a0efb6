"""Normalizers, string to string. `normalizer(config)` compiles one by its type; `register` adds a type of your own."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import CJK, WHITE_SPACE, Step
from tessera.functions.unicode_forms import normal

_REGISTRY: dict[str, Callable[[Config], list[Step]]] = {}


def register(name: str):
    def add(make: Callable[[Config], list[Step]]):
        _REGISTRY[name] = make
        return make

    return add


def normalizer(config: Config | dict | None) -> list[Step]:
    """The steps of a normalizer, none if there is no config."""
    config = Config.of(config)
    if config.is_null:
        return []
    kind = config.type.string()
    if kind not in _REGISTRY:
        raise ValueError(f"unknown normalizer {kind!r}")
    return _REGISTRY[kind](config)


def normalize(text, steps: list[Step]):
    for s in steps:
        text = s.column(text)
    return text


def prepend(prefix: str) -> Step:
    return Step(lambda c: F.concat(F.lit(prefix), c))


def replace(content: str, literal: str | None = None, pattern: str | None = None) -> Step:
    """Literal or pattern replaced by content; with neither, the text stays. $1 in content is a group."""
    if literal is not None:
        return Step(lambda c: F.replace(c, F.lit(literal), F.lit(content)))
    if pattern is not None:
        return Step(lambda c: F.regexp_replace(c, pattern, content))
    return Step(lambda c: c)


def lowercase() -> Step:
    return Step(F.lower)


def form(name: str) -> Step:
    """NFC, NFD, NFKC or NFKD."""
    return Step(lambda c: normal(c, name))


def clean() -> Step:
    """CR LF, tab, line feed and carriage return become one space; control characters stay."""
    return Step(lambda c: F.regexp_replace(c, "\r\n|[\t\n\r]", " "))


def space_cjk() -> Step:
    """A space on both sides of each ideograph (combining marks that follow it stay with it)."""
    return Step(lambda c: F.regexp_replace(c, rf"([{CJK}]\p{{M}}*)", " $1 "))


def without_marks(x: str) -> str:
    """Canonical decomposition without nonspacing marks."""
    return x if x.isascii() else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")


def strip_marks() -> Step:
    return Step(python=without_marks)


def strip(left: bool = True, right: bool = True) -> Step:
    def apply(c):
        c = F.regexp_replace(c, rf"^[{WHITE_SPACE}]+", "") if left else c
        return F.regexp_replace(c, rf"[{WHITE_SPACE}]+$(?!\n)", "") if right else c

    return Step(apply)


def charsmap() -> list[Step]:
    """Drops some control characters, turns separators into spaces, then NFKC around fullwidth tildes (empty parts vanish)."""
    dropped = r"[\x01-\x08\x0B\x0E-\x1F\x7F\x{8F}\x{9F}]"
    spaces = r"[\x09\x0A\x0C\x0D\x{1680}\x{200B}-\x{200F}\x{2028}\x{2029}\x{2581}\x{FEFF}\x{FFFD}]"
    tilde = "～"

    def compatible(c):
        parts = F.transform(F.filter(F.split(c, tilde), lambda p: p != ""), lambda p: normal(p, "NFKC"))
        return F.when(c.contains(tilde), F.array_join(parts, tilde)).otherwise(normal(c, "NFKC"))

    return [Step(lambda c: F.regexp_replace(F.regexp_replace(c, dropped, ""), spaces, " ")), Step(compatible)]


@register("Sequence")
def _sequence(c: Config) -> list[Step]:
    return [s for child in c.normalizers.array() for s in normalizer(child)]


@register("Prepend")
def _prepend(c: Config) -> list[Step]:
    return [prepend(c["prepend"].string(""))]


@register("Replace")
def _replace(c: Config) -> list[Step]:
    return [replace(c.content.string(""), c.pattern["String"].string(), c.pattern["Regex"].string())]


@register("Lowercase")
def _lowercase(c: Config) -> list[Step]:
    return [lowercase()]


for _form in ("NFC", "NFD", "NFKC", "NFKD"):
    register(_form)(lambda c, f=_form: [form(f)])


@register("StripAccents")
def _strip_accents(c: Config) -> list[Step]:
    """Despite its name this type is NFKC."""
    return [form("NFKC")]


@register("Precompiled")
def _precompiled(c: Config) -> list[Step]:
    return charsmap()


@register("Strip")
def _strip(c: Config) -> list[Step]:
    return [strip(c.stripLeft.boolean(True), c.stripRight.boolean(True))]


@register("BertNormalizer")
@register("Bert")
def _bert(c: Config) -> list[Step]:
    lower = c.lowercase.boolean(True)
    steps = [clean()] if c.cleanText.boolean(True) else []
    steps += [space_cjk()] if c.handleChineseChars.boolean(True) else []
    steps += [strip_marks()] if c.stripAccents.boolean(lower) else []
    return steps + ([lowercase()] if lower else [])
