"""Pre-tokenizers, string to array of strings, all as native Column functions.

`pretokenizer(config)` compiles one by its type into f(text, first), where first says whether the text begins the input;
`register` adds a type of your own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as t

Split = Callable[[Column, Column], Column]
_REGISTRY: dict[str, Callable[[Config], Split]] = {}


def register(name: str):
    def add(make: Callable[[Config], Split]):
        _REGISTRY[name] = make
        return make

    return add


def pretokenizer(config: Config | dict | None) -> Split:
    """Without a config, the text is one piece."""
    config = Config.of(config)
    if config.is_null:
        return lambda c, first: F.array(c)
    kind = config.type.string()
    if kind not in _REGISTRY:
        raise ValueError(f"unknown pre-tokenizer {kind!r}")
    return _REGISTRY[kind](config)


def late(config: Config | dict | None) -> tuple[Split, Callable[[str], str] | None]:
    """The pre-tokenizer without a byte mapping at its end, and that mapping for single pieces (None if it does not end in one): a
    model that works on distinct pieces maps these only."""
    config = Config.of(config)
    kind = None if config.is_null else config.type.string()
    if kind == "ByteLevel" and _REGISTRY[kind] is _byte_level:
        prefix, pattern = config.addPrefixSpace.boolean(False), config.useRegex.boolean(True)
        return lambda text, first: byte_split(text) if pattern else F.array(text), t.Mapped(prefix)
    children = config.pretokenizers.array() if kind == "Sequence" and _REGISTRY[kind] is _sequence else []
    if children:
        last, mapped = late(children[-1])
        before = pretokenizer({"type": "Sequence", "pretokenizers": [c.native() for c in children[:-1]]})
        return lambda text, first: over(last, before(text, first), first), mapped
    return pretokenizer(config), None


def over(split: Split, texts: Column, first: Column | None = None) -> Column:
    """The pieces of all texts of an array, in one array; only the first text can begin the input."""
    first = F.lit(True) if first is None else first
    return F.flatten(F.transform(texts, lambda x, i: split(x, first & (i == 0))))


def whitespace(c: Column) -> Column:
    """Runs of what is not a space."""
    return t.find_all(c, t.WORDS)


def blanks(c: Column) -> Column:
    """Runs of what is neither a space of any kind nor a tab; line feeds are part of them."""
    return t.find_all(c, f"[^{t.BLANK}]+")


def bert(c: Column) -> Column:
    """Words and single punctuation marks."""
    return t.find_all(c, t.BERT)


def punctuation(c: Column) -> Column:
    return t.find_all(c, t.PUNCTUATION_RUNS)


def digits(c: Column, individual: bool = False) -> Column:
    return t.find_all(c, t.DIGITS_APART if individual else t.DIGIT_RUNS)


def byte_split(c: Column) -> Column:
    """Pieces of the byte-level pattern, as they are."""
    return t.find_all(c, t.BYTE_LEVEL)


def byte_level(c: Column, prefix: bool = False, regex: bool = True) -> Column:
    """Pieces of the byte-level pattern, their bytes as characters. With `prefix` every piece that does not begin with a space gets one."""
    pieces = byte_split(c) if regex else F.array(c)
    if prefix:
        pieces = F.transform(pieces, lambda x: F.when(x.startswith(" "), x).otherwise(F.concat(F.lit(" "), x)))
    return F.transform(pieces, t.to_bytes)


def hexa(c: Column) -> Column:
    """<0xNN> of every byte."""
    return F.transform(t.find_all(F.hex(F.encode(c, "UTF-8")), ".."), lambda x: F.concat(F.lit("<0x"), x, F.lit(">")))


def metaspace(c: Column, first: Column, mark: str = t.UNDERLINE, scheme: str = "always", shown: str | None = None) -> Column:
    """Spaces become the mark; every piece begins with one, as far as the text has them or the scheme adds one at its front."""
    marked = F.replace(c, F.lit(" "), F.lit(mark if shown is None else shown))
    add = {"always": F.lit(True), "first": first, "never": F.lit(False)}[scheme]
    marked = F.when(add & ~marked.startswith(mark), F.concat(F.lit(mark if shown is None else shown), marked)).otherwise(marked)
    return split_behaviour(marked, mark, "merged_with_next")


def split_string(c: Column, separator: str, keep: bool) -> Column:
    """Non-empty pieces between separators, with the separators as pieces if kept."""
    e = t.escape(separator)
    if keep:
        return t.between(c, e)
    return F.filter(F.split(c, e, -1), lambda x: x != "")


def split_regex(c: Column, pattern: str) -> Column:
    """Non-empty pieces and the separators between them, which always stay. Patterns that match nothing are rejected."""
    import regex

    if regex.compile(pattern).match("") is not None:
        raise ValueError("the pattern matches the empty string")
    return t.between(c, pattern)


def split_captures(c: Column, pattern: str) -> Column:
    """Non-empty pieces between matches, and of each match its last group that took part, or all of it. A text without a match is one piece. A group that
    took part with nothing counts as one that did not. Patterns that match nothing are rejected."""
    import regex

    compiled = regex.compile(pattern)
    if compiled.match("") is not None:
        raise ValueError("the pattern matches the empty string")
    groups = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in range(compiled.groups, -1, -1)]
    gaps = F.split(c, pattern, -1)
    kept = F.transform(groups[-1], lambda _, i: F.coalesce(*(F.nullif(F.get(g, i), F.lit("")) for g in groups)))
    both = F.flatten(F.zip_with(gaps, kept, lambda gap, match: F.array(gap, match)))
    return F.when(F.size(kept) == 0, F.array(c)).otherwise(F.filter(both, lambda x: x != ""))


def split_behaviour(c: Column, separator: str, behaviour: str) -> Column:
    """removed, isolated, merged_with_previous or merged_with_next."""
    e = t.escape(separator)
    if behaviour == "removed":
        return split_string(c, separator, False)
    if behaviour == "isolated":
        return split_string(c, separator, True)
    pattern = {"merged_with_previous": f"(?<={e})", "merged_with_next": f"(?={e})"}[behaviour]
    return F.filter(F.split(c, pattern, -1), lambda x: x != "")


def ranges(c: Column, pattern: str) -> Column:
    """(start, end) of all matches, in code points."""
    pieces = F.regexp_extract_all(c, F.lit(f"((?s:.*?))({pattern})"), F.lit(1)), F.regexp_extract_all(c, F.lit(f"((?s:.*?))({pattern})"), F.lit(2))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.char_length(x["0"])
        end = start + F.char_length(x["1"])
        return F.struct(end.alias("at"), F.concat(s["found"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("found"))

    return F.aggregate(F.arrays_zip(*[p.alias(str(i)) for i, p in enumerate(pieces)]), zero, step, lambda s: s["found"])


@register("Sequence")
def _sequence(c: Config) -> Split:
    children = [pretokenizer(x) for x in c.pretokenizers.array()]

    def split(text: Column, first: Column) -> Column:
        out = F.array(text)
        for child in children:
            out = over(child, out, first)
        return out

    return split


@register("Whitespace")
@register("WhitespaceSplit")
def _whitespace(c: Config) -> Split:
    """Both types split at spaces only."""
    return lambda text, first: whitespace(text)


@register("BertPreTokenizer")
def _bert(c: Config) -> Split:
    return lambda text, first: bert(text)


@register("Punctuation")
def _punctuation(c: Config) -> Split:
    return lambda text, first: punctuation(text)


@register("Digits")
def _digits(c: Config) -> Split:
    return lambda text, first: digits(text, c.individualDigits.boolean(False))


@register("ByteLevel")
def _byte_level(c: Config) -> Split:
    return lambda text, first: byte_level(text, c.addPrefixSpace.boolean(False), c.useRegex.boolean(True))


def scheme_of(c: Config) -> str:
    """prepend_scheme (an unknown one is always); else always, or never if add_prefix_space is false."""
    explicit = c.prependScheme.string()
    if explicit is not None:
        return explicit if explicit in ("first", "never", "always") else "always"
    return "always" if c.addPrefixSpace.boolean(True) else "never"


@register("Metaspace")
def _metaspace(c: Config) -> Split:
    mark = c.replacement.string(" ")
    return lambda text, first: metaspace(text, first, mark, scheme_of(c), c.strRep.string(mark))


@register("Split")
def _split(c: Config) -> Split:
    literal, pattern = c.pattern["String"].string(), c.pattern["Regex"].string()
    if pattern is not None:
        return lambda text, first: split_regex(text, pattern)
    return lambda text, first: split_string(text, literal or "", not c.invert.boolean(False))
