"""Configurations as data: a column of relaxed JSON as VARIANT, read by key with coercion, in the JVM.

What a `config.Config` is for one tree on the driver, these are for a column of trees. A missing key or place is NULL, a JSON null the VARIANT null;
both count as null nodes. Numbers without a fraction are integers if they fit 64 bits, other numbers floating."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of JSON text: a string, or what is outside of strings.
_PARTS = r'("(?:[^"\\]|\\.)*+"|[^"]++|")'
_COMMA, _NUMBER = r",(?=\s*[}\]])", r"\b(?:Inf(?:inity)?|(?i:nan))\b"


def parse(text: Column) -> Column:
    """VARIANT of JSON that may begin with a byte-order mark and have trailing commas, Infinity, Inf and NaN; NULL of what is no JSON, or has a
    key twice. VARIANTs are read from text, where a NaN can only be null."""
    text = F.regexp_replace(text, "^\ufeff", "")

    def mended(part: Column) -> Column:
        part = F.regexp_replace(F.regexp_replace(part, r"-?\b(?i:nan)\b", "null"), r"\bInf(?:inity)?\b", "1e999")
        return F.regexp_replace(part, _COMMA, "")

    parts = F.regexp_extract_all(text, F.lit(_PARTS), 1)
    mended_text = F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(mended(p))), "")
    return F.try_parse_json(F.when(text.rlike(f"{_COMMA}|{_NUMBER}"), mended_text).otherwise(text))


def uncamel(key: Column) -> Column:
    """snake_case of camelCase; of consecutive capitals only the first gets an underscore."""
    return F.lower(F.regexp_replace(key, r"([^\p{Lu}\p{Lt}])([\p{Lu}\p{Lt}])", "$1_$2"))


def _of(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


#: Kinds by the first word of a VARIANT's schema; all others are floating.
_KINDS = {"VOID": "null", "STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "OBJECT": "dictionary", "ARRAY": "array"}


def kind(v: Column) -> Column:
    """null, string, integer, boolean, floating, array or dictionary."""
    word = F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "^[A-Z]+", 0)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair)), word), F.lit("floating"))


def _let(then: Callable[[Column], Column], **values: Column) -> Column:
    """An expression of a struct of values, each of which is then in the plan once."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in values.items()))), then), 0)


def get(v: Column, *path: str | int | Column) -> Column:
    """The node at a path of keys and places: for a key the dictionary's own entry, else that of its snake_case form; for a place that of the array.
    A key may be a column."""
    for step in path:
        if isinstance(step, int):
            v = F.try_variant_get(v, f"$[{step}]", "variant") if step >= 0 else F.lit(None).cast("variant")
            continue
        key = F.lit(step) if isinstance(step, str) else step
        entries = _of(v, "map<string,variant>")
        v = F.coalesce(F.try_element_at(entries, key), F.try_element_at(entries, uncamel(key)))
    return v


def is_null(v: Column) -> Column:
    return kind(v) == "null"


def _or(found: Column, default) -> Column:
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def string(v: Column, default=None) -> Column:
    return _or(F.when(kind(v) == "string", _of(v, "string")), default)


def integer(v: Column, default=None) -> Column:
    return _or(F.when(kind(v) == "integer", _of(v, "bigint")), default)


def boolean(v: Column, default=None) -> Column:
    """A boolean; of an integer, whether it is 1; of a string, true/t/1 or false/f/0 in any case."""
    of, text = kind(v), F.lower(_of(v, "string"))
    named = F.when(text.isin("true", "t", "1"), True).when(text.isin("false", "f", "0"), False)
    return _or(F.when(of == "boolean", _of(v, "boolean")).when(of == "integer", _of(v, "bigint") == 1).when(of == "string", named), default)


def floating(v: Column, default=None) -> Column:
    """32-bit: a floating number, or an integer widened."""
    return _or(F.when(kind(v).isin("floating", "integer"), _of(v, "double").cast("float")), default)


def array(v: Column) -> Column:
    """array<variant>, NULL of other kinds."""
    return F.when(kind(v) == "array", _of(v, "array<variant>"))


def dictionary(v: Column) -> Column:
    """map<string,variant>, NULL of other kinds."""
    return F.when(kind(v) == "dictionary", _of(v, "map<string,variant>"))


def token(v: Column) -> Column:
    """struct<id, token> of an array of both, in either order; ids are not negative where they come first."""
    items = array(v)
    a, b = F.get(items, 0), F.get(items, 1)
    first = F.when((kind(a) == "string") & (kind(b) == "integer"), F.struct(integer(b).alias("id"), string(a).alias("token")))
    second = F.when((integer(a) >= 0) & (kind(b) == "string"), F.struct(integer(a).alias("id"), string(b).alias("token")))
    return F.when(F.size(items) == 2, F.coalesce(first, second))


def equals(a: Column, b: Column, depth: int = 2) -> Column:
    """Equal nodes; also if one's kind can be read as the other's. Entries of dictionaries and arrays are compared so down to `depth`, below
    that as canonical JSON."""

    def compared(s: Column) -> Column:
        a, b, left, right = (s[c] for c in ("a", "b", "left", "right"))
        either = lambda k: (left == k) | (right == k)
        out = (
            F.when((left == "null") | (right == "null"), left == right)
            .when((left == right) & left.isin("string", "integer"), encode(a) == encode(b))
            .when(either("boolean"), F.coalesce(boolean(a) == boolean(b), F.lit(False)))
            .when(either("floating"), F.coalesce(floating(a) == floating(b), F.lit(False)))
            .when((left != right) | left.isin("string", "integer"), False)
        )
        if not depth:
            return out.otherwise(encode(a) == encode(b))
        xs, ys, x, y = (_of(v, k) for k in ("array<variant>", "map<string,variant>") for v in (a, b))
        same_items = (F.size(xs) == F.size(ys)) & F.forall(F.zip_with(xs, ys, lambda p, q: equals(p, q, depth - 1)), lambda e: e)
        keys = lambda m: F.array_sort(F.map_keys(m))
        same_entries = (keys(x) == keys(y)) & F.forall(F.map_values(F.map_zip_with(x, y, lambda _, p, q: equals(p, q, depth - 1))), lambda e: e)
        return out.when(left == "array", same_items).otherwise(same_entries)

    return _let(compared, a=a, b=b, left=kind(a), right=kind(b))


def hashed(v: Column) -> Column:
    """A hash of kind and value; keys' order does not count."""
    return F.xxhash64(kind(v), F.coalesce(encode(v), F.lit("null")))


def encode(v: Column) -> Column:
    """JSON, with keys in order."""
    return F.to_json(v)


def merged(left: Column, right: Column) -> Column:
    """Both dictionaries' entries; where both have one, the right side's. A null side gives the other."""
    both = F.map_zip_with(dictionary(left), dictionary(right), lambda _, x, y: F.coalesce(y, x))
    return F.when(is_null(right), left).when(is_null(left), right).otherwise(F.to_variant_object(both))


def entries(df: DataFrame, column: str, outer: bool = False) -> DataFrame:
    """A row for each entry of a dictionary or array: the columns, and pos, key (NULL in arrays), value."""
    found = F.col(column).outer()
    explode = df.sparkSession.tvf.variant_explode_outer if outer else df.sparkSession.tvf.variant_explode
    return df.lateralJoin(explode(found))
