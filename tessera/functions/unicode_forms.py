"""Unicode's normal forms as Column expressions. The tables are made from Python's `unicodedata` when they are first needed.

A text that a form cannot change, as it holds no character of the form's class, is told by one pattern and stays as it is. Else

* characters that decompose are looked up by code point in a table of pages, Hangul by arithmetic;
* combining marks in a row are sorted by their class, stably;
* a character and what may join it are folded: each next one joins the first if their pair is composed and nothing of the same or a higher class is between.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
_LATIN = 0x300
_PAGE = 7  # bits of a code point's place in its page
_END = "\x01"  # between entries of tables; no entry holds it
# Hangul syllables: first syllable, leading, vowel and trailing letters (fixed values)
_S, _L, _V, _T, _NL, _NV, _NT = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28


def _hangul(c: int) -> bool:
    return _S <= c < _S + _NL * _NV * _NT


@cache
def _characters() -> list[str]:
    return [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]


def _decompositions(name: str) -> dict[str, str]:
    return {c: d for c in _characters() if not c.isascii() and not _hangul(ord(c)) and (d := unicodedata.normalize(name, c)) != c}


@cache
def canonical() -> dict[str, str]:
    """Full canonical decompositions of all characters but Hangul that have one."""
    return _decompositions("NFD")


@cache
def compatible() -> dict[str, str]:
    """The same with compatibility decompositions."""
    return _decompositions("NFKD")


@cache
def classes() -> dict[str, int]:
    """Combining classes that are not 0."""
    return {c: k for c in _characters() if (k := unicodedata.combining(c))}


@cache
def pairs() -> dict[tuple[str, str], str]:
    """Composed characters by the two that they are made of, but Hangul."""
    out = {}
    for c in _characters():
        of = unicodedata.decomposition(c)
        if of and not of.startswith("<") and len(of.split()) == 2:
            a, b = (chr(int(x, 16)) for x in of.split())
            if unicodedata.normalize("NFC", a + b) == c:
                out[a, b] = c
    return out


def ranges(characters: Iterable[str]) -> str:
    """The inside of a pattern's class of these characters."""
    out: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


@cache
def _class(make: Callable[[], Iterable[str]]) -> str:
    """A class of characters beyond ASCII. Its pattern first tells ASCII, then Latin letters from the many ranges of others."""
    characters = set(make())
    high = [c for c in characters if ord(c) >= _LATIN]
    low = [c for c in characters if ord(c) < _LATIN]
    return f"[[^\\x00-\\x7F]&&[{ranges(low)}[[^\\x00-\\x{{{_LATIN - 1:X}}}]&&[{ranges(high)}]]]]"


@cache
def _others(make: Callable[[], Iterable[str]]) -> str:
    """The class of all other characters."""
    return f"[\\x00-\\x7F[^{ranges(make())}]]"


def _syllables() -> list[str]:
    return [chr(c) for c in range(_S, _S + _NL * _NV * _NT)]


def _decomposing() -> set[str]:
    return {*canonical(), *_syllables()}


def _decomposing_compatibly() -> set[str]:
    return {*compatible(), *_syllables()}


def _joining() -> set[str]:
    """Characters that may join one before them, or stand between."""
    return {*classes(), *(b for _, b in pairs()), *(chr(c) for c in range(_V, _V + _NV)), *(chr(c) for c in range(_T + 1, _T + _NT))}


def _firsts() -> dict[str, int]:
    return {c: i for i, c in enumerate(sorted({a for a, _ in pairs()}))}


def _seconds() -> dict[str, int]:
    return {c: i for i, c in enumerate(sorted({b for _, b in pairs()}))}


#: By form, the characters without which a text has it.
_CHANGING: dict[str, Callable[[], Iterable[str]]] = {
    "NFD": lambda: {*_decomposing(), *classes()},
    "NFKD": lambda: {*_decomposing_compatibly(), *classes()},
    "NFC": lambda: {*(c for c in _characters() if not c.isascii() and unicodedata.normalize("NFC", c) != c), *_joining()},
    "NFKC": lambda: {*(c for c in _characters() if not c.isascii() and unicodedata.normalize("NFKC", c) != c), *_joining()},
}


@cache
def _page_texts(make: Callable[[], dict[str, object]], empty: object) -> tuple[str, str]:
    size = 1 << _PAGE
    found: dict[int, list[object]] = {}
    for c, entry in make().items():
        found.setdefault(ord(c) >> _PAGE, [empty] * size)[ord(c) & (size - 1)] = entry
    numbers = {p: i for i, p in enumerate(sorted(found), 1)}
    pages = [numbers.get(p, 0) for p in range((sys.maxunicode >> _PAGE) + 1)]
    entries = [empty] * size + [e for p in sorted(found) for e in found[p]]
    return _END.join(map(str, pages)), _END.join(map(str, entries))


def _pages(make: Callable[[], dict[str, object]], empty: object) -> tuple[Column, Column]:
    """Two arrays of a table: the page of each group of code points, and the entries of all pages; page 0 is empty."""
    pages, entries = (F.split(F.lit(x), _END, -1) for x in _page_texts(make, empty))
    return pages.cast("array<int>"), entries


def _let(then: Callable[[Column], Column], **values: Column) -> Column:
    """An expression of a struct of values, each of which, with its tables, is then in the plan once."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in values.items()))), then), 0)


def _look_up(table: tuple[Column, Column], c: Column) -> Column:
    pages, entries = table
    return F.get(entries, F.get(pages, F.shiftright(F.ascii(c), _PAGE)) * (1 << _PAGE) + F.ascii(c).bitwiseAND((1 << _PAGE) - 1))


def _each(text: Column, pattern: str, rest: str, change: Callable[[Column], Column]) -> Column:
    """The text with each match of a pattern changed; the rest has a pattern of its own. (A pattern for splitting would be compiled for every row.)"""
    pieces = F.regexp_extract_all(text, F.lit(f"{pattern}|{rest}"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^" + pattern), change(p)).otherwise(p)), "")


def decompose(text: Column, compatibly: bool) -> Column:
    """Characters decomposed, and marks in order."""
    table = _pages(compatible if compatibly else canonical, "")
    characters = _decomposing_compatibly if compatibly else _decomposing
    changing, others = _class(characters), _others(characters)

    def one(c: Column) -> Column:
        code = F.ascii(c) - _S
        letter = lambda base, i: _char(F.lit(base) + i)
        lead, vowel, trail = F.floor(code / (_NV * _NT)).cast("int"), F.floor(code % (_NV * _NT) / _NT).cast("int"), code % _NT
        syllable = F.concat(letter(_L, lead), letter(_V, vowel), F.when(trail == 0, "").otherwise(letter(_T, trail)))
        return F.when((code >= 0) & (code < _NL * _NV * _NT), syllable).otherwise(F.coalesce(F.nullif(_look_up(table, c), F.lit("")), c))

    split = _each(text, changing + "+", others + "+", lambda run: F.array_join(F.transform(F.split(run, ""), one), ""))
    return _in_order(F.when(text.rlike(changing), split).otherwise(text))


def _char(code: Column) -> Column:
    """The character of a code point of the plane of Hangul's letters and syllables, from its three bytes of UTF-8."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    return F.decode(F.unhex(F.concat(byte(F.shiftright(code, 12) + 0xE0), byte(F.shiftright(code, 6).bitwiseAND(0x3F) + 0x80), byte(code.bitwiseAND(0x3F) + 0x80))), "UTF-8")


def _in_order(text: Column) -> Column:
    """Marks in a row by class; of equal classes as they are."""
    mark = _class(classes)
    marks = mark + "{2,}"
    numbers = _pages(classes, 0)
    placed = lambda c, i: F.struct(_look_up(numbers, c).cast("int").alias("k"), i.alias("i"), c.alias("c"))
    ordered = _each(text, marks, f"{_others(classes)}+|{mark}", lambda run: F.array_join(F.transform(F.array_sort(F.transform(F.split(run, ""), placed)), lambda s: s["c"]), ""))
    return F.when(text.rlike(marks), ordered).otherwise(text)


def compose(text: Column) -> Column:
    """A decomposed text with characters composed."""
    width = len(_seconds())
    matrix = F.split(F.lit(_END.join(pairs().get((a, b), "") for a in _firsts() for b in _seconds())), _END, -1)
    row, column = _pages(_firsts, -1), _pages(_seconds, -1)
    numbers = _pages(classes, 0)

    def pair(a: Column, b: Column) -> Column:
        place = _let(lambda s: F.when((s["x"] >= 0) & (s["y"] >= 0), s["x"] * width + s["y"]), x=_look_up(row, a).cast("int"), y=_look_up(column, b).cast("int"))
        lead, vowel, syllable, trail = F.ascii(a) - _L, F.ascii(b) - _V, F.ascii(a) - _S, F.ascii(b) - _T
        within = lambda v, n: (v >= 0) & (v < n)
        return (
            F.when(within(lead, _NL) & within(vowel, _NV), _char((lead * _NV + vowel) * _NT + _S))
            .when(within(syllable, _NL * _NV * _NT) & (syllable % _NT == 0) & (trail > 0) & (trail < _NT), _char(F.ascii(a) + trail))
            .otherwise(F.coalesce(F.get(matrix, place), F.lit("")))
        )

    def state(done: Column, first: Column, marks: Column, last: Column) -> Column:
        return F.struct(done.alias("done"), first.alias("first"), marks.alias("marks"), last.cast("int").alias("last"))

    def add(s: Column, c: Column) -> Column:
        def added(v: Column) -> Column:
            k, joined = v["k"], v["joined"]
            return (
                F.when((joined != "") & ((s["marks"] == "") | ((s["last"] < k) & (k > 0))), state(s["done"], joined, s["marks"], s["last"]))
                .when(k == 0, state(F.concat(s["done"], s["first"], s["marks"]), c, F.lit(""), F.lit(0)))
                .otherwise(state(s["done"], s["first"], F.concat(s["marks"], c), k))
            )

        return _let(added, k=_look_up(numbers, c).cast("int"), joined=F.when(s["first"] == "", "").otherwise(pair(s["first"], c)))

    empty = state(F.lit(""), F.lit(""), F.lit(""), F.lit(0))
    fold = lambda run: F.aggregate(F.split(run, ""), empty, add, lambda s: F.concat(s["done"], s["first"], s["marks"]))
    joining, other = _class(_joining), _others(_joining)
    # one that is not joining, and what joins it
    return F.when(text.rlike(joining), _each(text, f"{other}?{joining}+", f"{other}+(?={other}|\\z)", fold)).otherwise(text)


def normal(text: Column, name: str) -> Column:
    """The text in one of the FORMS."""
    if name not in FORMS:
        raise ValueError(f"no normal form {name!r}")
    out = decompose(text, "K" in name)
    return F.when(text.rlike(_class(_CHANGING[name])), compose(out) if name.endswith("C") else out).otherwise(text)
