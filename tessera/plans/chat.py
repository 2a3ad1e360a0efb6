"""Chat templates: presets as Column expressions, and a small template language for templates from configurations.

The language has for (with loop.index0, index, first, last), if / elif / else, set, output with filters (trim, tojson, length, upper, lower,
default, join, first, last), comparison, and / or / not, in, string concatenation with + and ~, subscripts and attributes,
raise_exception(), white-space control with -, and trims blocks as templates of chats expect (a line with only a block
leaves nothing). Anything else is an error when the template is compiled. Compiled templates are kept per worker."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import Config


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Choice:
    """A template of its own, or the name of one of the configured ones."""

    literal: str | None = None
    name: str | None = None


def select(configured: Config, choice: Choice | None = None, tools: list | None = None) -> str:
    """A literal wins; of several configured templates the named one, else tool_use if there are tools, else default; a single one as it is."""
    if choice is not None and choice.literal is not None:
        return choice.literal
    if configured.array():
        named = {x["name"].string(): x["template"].string() for x in configured.array()}
        if choice is not None and choice.name is not None:
            if choice.name not in named:
                raise TemplateError(f"no chat template is named {choice.name!r}")
            return named[choice.name]
        if tools and "tool_use" in named:
            return named["tool_use"]
        if "default" in named:
            return named["default"]
    elif configured.string() is not None:
        return configured.string()
    raise TemplateError("there is no chat template")


_PART = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)


def _split(source: str) -> list[tuple[str, str]]:
    """("text", ...), ("out", expression) and ("block", statement)."""
    out: list[tuple[str, str]] = []
    at, strip, after_block = 0, False, False
    for m in _PART.finditer(source):
        text = source[at : m.start()]
        if strip:
            text = text.lstrip()
        elif after_block and text.startswith("\n"):
            text = text[1:]
        is_out = m[2] is not None
        left = m[1] or m[4] or m[7]
        if left:
            text = text.rstrip()
        elif not is_out:
            line = text.rpartition("\n")[2]
            if not line.strip(" \t") and (m.start() - len(line) == 0 or "\n" in text or source[m.start() - len(line) - 1 : m.start() - len(line)] == "\n"):
                text = text[: len(text) - len(line)]
        out.append(("text", text))
        if is_out:
            out.append(("out", m[2].strip()))
        elif m[5] is not None:
            out.append(("block", m[5].strip()))
        strip, after_block, at = bool(m[3] or m[6] or m[8]), not is_out, m.end()
    text = source[at:]
    out.append(("text", text.lstrip() if strip else text[1:] if after_block and text.startswith("\n") else text))
    return [x for x in out if x[1]]


_FILTERS: dict[str, Callable] = {
    "trim": lambda x: str(x).strip(), "tojson": lambda x, indent=None: json.dumps(x, ensure_ascii=False, indent=indent), "length": len, "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(), "default": lambda x, d="": d if x is None else x, "join": lambda x, s="": s.join(map(str, x)), "first": lambda x: x[0], "last": lambda x: x[-1],
    "string": str, "list": list, "items": lambda x: list(x.items()),
}


_WORDS = (
    (r"\bis\s+not\s+(defined|none|string|mapping|iterable)\b", r" % (not_\1)"), (r"\bis\s+(defined|none|string|mapping|iterable)\b", r" % (is_\1)"),
    (r"\btrue\b", "True"), (r"\bfalse\b", "False"), (r"\bnone\b", "None"), (r"~", "<<"), (r"\|", "**"),
)


def _words(expression: str) -> str:
    """The expression in Python's words, outside of its strings: operators of as low or high precedence stand for ~ (<<, below sums) and | (**, above
    all but calls), tests are remainders by a name. Strings may hold line feeds."""
    parts = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", expression)
    for pattern, to in _WORDS:
        parts[::2] = [re.sub(pattern, to, p) for p in parts[::2]]
    parts[1::2] = [p.replace("\n", "\\n") for p in parts[1::2]]
    return "".join(parts)


def _condition(expression: str) -> tuple[ast.expr, ast.expr | None]:
    """What a loop is over, and the condition of its items, if it has one (a condition with else is a value)."""
    try:
        return _python(expression), None
    except TemplateError:
        for m in reversed(list(re.finditer(r"\sif\s", expression))):
            try:
                return _python(expression[: m.start()]), _python(expression[m.end() :])
            except TemplateError:
                continue
        raise


def _python(expression: str) -> ast.expr:
    """The expression as Python syntax: filters become calls, ~ concatenation, tests become calls."""
    e = _words(expression)
    try:
        return ast.parse(e.strip(), mode="eval").body
    except SyntaxError as x:
        raise TemplateError(f"cannot read the expression {expression!r}") from x


_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.FloorDiv: lambda a, b: a // b, ast.LShift: lambda a, b: f"{'' if a is None else a}{'' if b is None else b}"}
_TESTS = {"defined": lambda x: x is not None, "none": lambda x: x is None, "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, dict), "iterable": lambda x: isinstance(x, (list, str, dict))}


def filters(e: ast.BinOp) -> tuple[ast.expr, list[tuple[str, list[ast.expr], dict[str, ast.expr]]]]:
    """What filters are applied to, and these in order: name, arguments, named ones."""
    chain, rest = [], e
    while isinstance(rest, ast.BinOp) and isinstance(rest.op, ast.Pow):
        chain.append(rest.left)
        rest = rest.right
    first, *steps = [*chain, rest]
    found = []
    for x in steps:
        call = isinstance(x, ast.Call)
        name = x.func if call else x
        if not isinstance(name, ast.Name):
            raise TemplateError("a filter has no name")
        found.append((name.id, list(x.args) if call else [], {k.arg: k.value for k in x.keywords} if call else {}))
    return first, found


def _value(e: ast.expr, scope: dict[str, Any]) -> Any:
    match e:
        case ast.Constant():
            return e.value
        case ast.Name():
            return scope.get(e.id)
        case ast.List() | ast.Tuple():
            return [_value(x, scope) for x in e.elts]
        case ast.Attribute():
            of = _value(e.value, scope)
            return of.get(e.attr) if isinstance(of, dict) else None
        case ast.Subscript(slice=ast.Slice()):
            part = [None if x is None else _value(x, scope) for x in (e.slice.lower, e.slice.upper, e.slice.step)]
            return _value(e.value, scope)[slice(*part)]
        case ast.Subscript():
            of, key = _value(e.value, scope), _value(e.slice, scope)
            return of.get(key) if isinstance(of, dict) else of[key] if isinstance(of, (list, str)) and -len(of) <= key < len(of) else None
        case ast.BoolOp():
            out = None
            for x in e.values:
                out = _value(x, scope)
                if bool(out) != isinstance(e.op, ast.And):
                    return out
            return out
        case ast.UnaryOp(op=ast.Not()):
            return not _value(e.operand, scope)
        case ast.UnaryOp(op=ast.USub()):
            return -_value(e.operand, scope)
        case ast.Compare():
            left = _value(e.left, scope)
            for op, x in zip(e.ops, e.comparators, strict=True):
                right = _value(x, scope)
                if not _COMPARE[type(op)](left, right):
                    return False
                left = right
            return True
        case ast.IfExp():
            return _value(e.body, scope) if _value(e.test, scope) else _value(e.orelse, scope)
        case ast.BinOp(op=ast.Mod(), right=ast.Name(id=name)) if name.partition("_")[0] in ("is", "not") and name.partition("_")[2] in _TESTS:
            return _TESTS[name.partition("_")[2]](_value(e.left, scope)) == name.startswith("is")
        case ast.BinOp(op=ast.Mod()):
            return _value(e.left, scope) % _value(e.right, scope)
        case ast.BinOp(op=ast.Pow()):
            out, steps = filters(e)
            out = _value(out, scope)
            for name, extra, named in steps:
                if name not in _FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                out = _FILTERS[name](out, *(_value(x, scope) for x in extra), **{k: _value(x, scope) for k, x in named.items()})
            return out
        case ast.BinOp() if type(e.op) in _ARITHMETIC:
            return _ARITHMETIC[type(e.op)](_value(e.left, scope), _value(e.right, scope))
        case ast.Call(func=ast.Name(id="raise_exception")):
            raise TemplateError(str(_value(e.args[0], scope)))
        case ast.Call(func=ast.Name(id="namespace")):
            return {k.arg: _value(k.value, scope) for k in e.keywords}
        case ast.Call(func=ast.Name(id=name)) if isinstance(scope.get(name), Macro):
            return scope[name]([_value(x, scope) for x in e.args], {k.arg: _value(k.value, scope) for k in e.keywords})
        case ast.Call(func=ast.Name(id="range")):
            return list(range(*(_value(x, scope) for x in e.args)))
        case ast.Call(func=ast.Attribute(attr=name)) if name in ("strip", "lstrip", "rstrip", "upper", "lower", "startswith", "endswith", "split", "replace", "title", "items", "get"):
            out = getattr(_value(e.func.value, scope), name)(*(_value(x, scope) for x in e.args))
            return list(out) if name == "items" else out
    raise TemplateError(f"unsupported expression {ast.dump(e)[:60]}")


class Macro:
    """A part of a template with parameters; it sees what the template's scope holds when it is called."""

    def __init__(self, template: Template, names: list[str], defaults: dict[str, ast.expr], body: list, scope: dict[str, Any]):
        self.template, self.names, self.defaults, self.body, self.scope = template, names, defaults, body, scope

    def arguments(self, given: list, named: dict[str, Any], value: Callable) -> dict[str, Any]:
        return {n: given[i] if i < len(given) else named[n] if n in named else value(self.defaults[n]) if n in self.defaults else None for i, n in enumerate(self.names)}

    def __call__(self, given: list, named: dict[str, Any]) -> str:
        out: list[str] = []
        self.template._run(self.body, {**self.scope, **self.arguments(given, named, lambda d: _value(d, self.scope))}, out)
        return "".join(out)


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.parts = _split(source)
        self.at = 0
        self.body = self._block(())
        if self.at < len(self.parts):
            raise TemplateError(f"unexpected {self.parts[self.at][1]!r}")

    def _block(self, ends: tuple[str, ...]) -> list:
        out = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            word = value.split(None, 1)[0] if kind == "block" else ""
            if word in ends:
                return out
            self.at += 1
            if kind == "text":
                out.append(("text", value))
            elif kind == "out":
                out.append(("out", _python(value)))
            elif word == "set":
                name, _, e = value[3:].partition("=")
                out.append(("set", name.strip(), _python(e)))
            elif word == "for":
                m = re.fullmatch(r"for\s+(\w+(?:\s*,\s*\w+)*)\s+in\s+(.*)", value, re.S)
                if not m:
                    raise TemplateError(f"cannot read {value!r}")
                over, only = _condition(m[2])
                body, empty = self._block(("endfor", "else")), []
                if self._next() == "else":
                    empty = self._block(("endfor",))
                    self._end("endfor")
                out.append(("for", [x.strip() for x in m[1].split(",")], over, body, only, empty))
            elif word == "macro":
                try:
                    made = ast.parse(f"def {_words(value[5:].strip())}: pass").body[0]
                except SyntaxError as x:
                    raise TemplateError(f"cannot read {value!r}") from x
                body = self._block(("endmacro",))
                self._next()
                names = [a.arg for a in made.args.args]
                out.append(("macro", made.name, names, dict(zip(names[len(names) - len(made.args.defaults) :], made.args.defaults, strict=True)), body))
            elif word == "if":
                arms, test = [], _python(value[2:])
                while True:
                    arms.append((test, self._block(("elif", "else", "endif"))))
                    word, _, rest = self._next().partition(" ")
                    if word == "endif":
                        break
                    test = _python(rest) if word == "elif" else ast.Constant(True)
                out.append(("if", arms))
            else:
                raise TemplateError(f"unsupported statement {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out

    def _next(self) -> str:
        if self.at >= len(self.parts):
            raise TemplateError("a block does not end")
        self.at += 1
        return self.parts[self.at - 1][1]

    def _end(self, word: str) -> None:
        if self._next() != word:
            raise TemplateError(f"{word} is missing")

    def render(self, context: dict[str, Any]) -> str:
        out: list[str] = []
        self._run(self.body, dict(context), out)
        return "".join(out)

    def _run(self, body: list, scope: dict[str, Any], out: list[str]) -> None:
        for node in body:
            if node[0] == "text":
                out.append(node[1])
            elif node[0] == "out":
                x = _value(node[1], scope)
                out.append("" if x is None else x if isinstance(x, str) else str(x))
            elif node[0] == "set":
                if "." in node[1]:
                    of, _, key = node[1].partition(".")
                    scope[of][key] = _value(node[2], scope)
                else:
                    scope[node[1]] = _value(node[2], scope)
            elif node[0] == "macro":
                scope[node[1]] = Macro(self, *node[2:], scope)
            elif node[0] == "if":
                for test, arm in node[1]:
                    if _value(test, scope):
                        self._run(arm, scope, out)
                        break
            else:
                _, names, over, body, only, empty = node
                of = lambda item: dict(zip(names, item, strict=True)) if len(names) > 1 else {names[0]: item}
                items = [x for x in _value(over, scope) or [] if only is None or _value(only, {**scope, **of(x)})]
                for i, item in enumerate(items):
                    inner = {**scope, **of(item)}
                    inner["loop"] = {
                        "index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1, "length": len(items),
                        "previtem": items[i - 1] if i else None, "nextitem": items[i + 1] if i + 1 < len(items) else None,
                    }
                    self._run(body, inner, out)
                if not items:
                    self._run(empty, scope, out)


@lru_cache(64)
def compiled(source: str) -> Template:
    return Template(source)


def _plain(x: Any) -> Any:
    """Lists and dictionaries of what pandas gives for arrays and structs."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return _plain(x.asDict()) if hasattr(x, "asDict") else [_plain(y) for y in x] if isinstance(x, (list, tuple, np.ndarray)) else x


def render(source: str, context: dict[str, Any], fields: tuple[str, ...] | None = None) -> Callable[[Column], Column]:
    """Array of messages to text: as an expression in the JVM where the template can be one (chat_columns), else by a function in Python. Messages are structs
    with the texts role and content; `fields` names all their fields if these are texts, and is () if their contents are no texts."""
    from tessera.plans import chat_columns

    template = Template(source)

    @F.pandas_udf(T.StringType())
    def run(rows: pd.Series) -> pd.Series:
        template = compiled(source)
        return rows.map(lambda ms: template.render({"messages": _plain(ms), **context}), na_action="ignore")

    def rendered(ms: Column) -> Column:
        try:
            if fields == ():
                raise chat_columns.Unsupported
            return chat_columns.render(template, ms, fields, context)
        except chat_columns.Unsupported:
            return run(ms)

    return rendered


def messages(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(by, messages): each conversation's turns in order. A conversation is one value; its turns are summed up by key."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(by).agg(F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def _joined(ms: Column, one: Callable[[Column], Column], end: str) -> Column:
    return F.concat(F.array_join(F.transform(ms, one), ""), F.lit(end))


def chatml(ms: Column, add_generation_prompt: bool = False) -> Column:
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    return _joined(ms, one, "<|im_start|>assistant\n" if add_generation_prompt else "")


def llama_inst(ms: Column, bos: str = "<s>", eos: str = "</s>") -> Column:
    """User turns between [INST] marks, assistant turns ended, system turns between <<SYS>> marks."""

    def one(m: Column) -> Column:
        user = F.concat(F.lit(f"{bos}[INST] "), F.trim(m["content"]), F.lit(" [/INST]"))
        system = F.concat(F.lit("<<SYS>>\n"), F.trim(m["content"]), F.lit("\n<</SYS>>\n\n"))
        return F.when(m["role"] == "user", user).when(m["role"] == "system", system).otherwise(F.concat(F.lit(" "), F.trim(m["content"]), F.lit(f" {eos}")))

    return _joined(ms, one, "")
