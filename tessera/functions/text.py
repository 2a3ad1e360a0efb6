"""Character classes, the byte alphabet, and the Step that all text stages compile to."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the formats, in the form that Java, Python's regex and RE2 read alike.
SPACE = r"\t\n\f\r\p{Z}"
BLANK = r"\t\p{Zs}"
WHITE_SPACE = r"\t\n\x0B\f\r\x{85}\p{Z}"
PUNCTUATION = r"\p{P}!-/:-@\[-`{-~"
BERT = rf"[^{SPACE}{PUNCTUATION}]+|[{PUNCTUATION}]"
WORDS = rf"[^{SPACE}]+"
PUNCTUATION_RUNS = rf"[^{PUNCTUATION}]+|[{PUNCTUATION}]+"
DIGIT_RUNS, DIGITS_APART = r"[^\p{Nd}]+|\p{Nd}+", r"[^\p{Nd}]+|\p{Nd}"
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
UNDERLINE = "▁"


def python_class(ranges: str) -> str:
    """Ranges of \\x{...} as Python's regex module reads them."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), ranges)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable in Latin-1, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


BYTES = byte_alphabet()
_LATIN, _MAPPED = "".join(map(chr, range(1, 256))), "".join(BYTES[1:])


class Mapped:
    """A piece's UTF-8 bytes as characters, with a space before it if it has none and one is wanted."""

    def __init__(self, prefix: bool = False):
        self.prefix = prefix

    def __call__(self, piece: str) -> str:
        if self.prefix and not piece.startswith(" "):
            piece = " " + piece
        return "".join(map(BYTES.__getitem__, piece.encode()))


def to_bytes(text: Column) -> Column:
    """Each UTF-8 byte of the text as its character."""
    mapped = F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _LATIN, _MAPPED)
    return F.replace(mapped, F.lit("\0"), F.lit(BYTES[0]))


def from_bytes(text: Column) -> Column:
    """The text whose bytes the characters stand for; invalid UTF-8 becomes U+FFFD. Characters outside the alphabet are an error."""
    inside = f"[^{''.join(chr(92) + c if c in '[]^-&' + chr(92) else c for c in BYTES)}]"
    checked = F.when(text.rlike(inside), F.raise_error(F.lit("a character is not in the byte alphabet"))).otherwise(text)
    latin = F.translate(F.replace(checked, F.lit(BYTES[0]), F.lit("\0")), _MAPPED, _LATIN)
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


@dataclass(frozen=True)
class Step:
    """A stage from string to string, as a Column function or (if Spark has none) as a Python function for an Arrow UDF."""

    native: Callable[[Column], Column] | None = None
    python: Callable[[str], str] | None = None

    def column(self, text: Column) -> Column:
        return self.native(text) if self.native else _apply(self.python)(text)

    def array(self, texts: Column) -> Column:
        return F.transform(texts, self.native) if self.native else _apply_array(self.python)(texts)


def _apply(f: Callable[[str], str]):
    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return apply


def _apply_array(f: Callable[[str], str]):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def apply(rows: pd.Series) -> pd.Series:
        return rows.map(lambda xs: [None if x is None else f(x) for x in xs], na_action="ignore")

    return apply


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def between(text: Column, pattern: str, kept: Callable[[Column], Column] = lambda x: x) -> Column:
    """The non-empty pieces between a pattern's matches, and what is kept of these, in order. A pattern of which the same match can be empty in one
    place (by look-around) and not in another is not for this."""
    gaps, matches = F.split(text, pattern, -1), find_all(text, pattern)
    both = F.zip_with(gaps, matches, lambda gap, match: F.array(gap, kept(match)))
    return F.filter(F.flatten(both), lambda x: x != "")


def escape(literal: str) -> str:
    """A pattern for exactly this string, for Java and RE2."""
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in literal)
