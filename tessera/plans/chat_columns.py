"""Chat templates as Column expressions.

A template is run once, when the plan is made, with the context's values as they are and expressions in place of what comes from the messages. A test of
known values chooses its arm now, one of expressions becomes `when` over what both arms write and set. A loop over messages is `transform` and a join
of texts; one that changes a namespace is a fold whose state holds the text and the namespace's entries. Macros are put in where they are called.

Messages are an array of structs of texts. A missing entry is undefined; an undefined text is written as nothing, also in a sum."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import WHITE_SPACE, escape
from tessera.plans import chat


class Unsupported(Exception):
    """The template has something that is no expression here."""


@dataclass(frozen=True)
class Expr:
    """A value that rows decide: of kind text, number, flag, message (with these fields), or a list of a kind."""

    column: Column
    kind: str
    fields: tuple[str, ...] = ()

    @property
    def item(self) -> str:
        return self.kind.removeprefix("list of ")


class Space(dict):
    """A namespace: its entries outlive the loop that sets them."""


_KINDS = {str: "text", bool: "flag", int: "number"}


def _lift(x: Any) -> Expr:
    """A known value as an expression."""
    if isinstance(x, Expr):
        return x
    if type(x) not in _KINDS:
        raise Unsupported(f"{x!r} and an expression")
    return Expr(F.lit(x), _KINDS[type(x)])


def _one(a: Any, b: Any, choose: Callable[[Column, Column], Column]) -> Expr:
    """Two values of one kind as one; an undefined one is null."""
    if a is None and b is None:
        return None
    kind = _lift(a if a is not None else b)
    columns = [F.lit(None) if x is None else _lift(x).column for x in (a, b)]
    if any(x is not None and (_lift(x).kind, _lift(x).fields) != (kind.kind, kind.fields) for x in (a, b)):
        raise Unsupported("values of two kinds")
    return Expr(choose(*columns), kind.kind, kind.fields)


def _written(x: Any) -> Column | str:
    """A value as a template writes it."""
    if not isinstance(x, Expr):
        return "" if x is None else x if isinstance(x, str) else str(x)
    if x.kind == "text":
        return F.coalesce(x.column, F.lit(""))
    if x.kind == "number":
        return F.coalesce(x.column.cast("string"), F.lit(""))
    if x.kind == "flag":
        return F.when(x.column.isNull(), "").when(x.column, "True").otherwise("False")
    raise Unsupported(f"writing a {x.kind}")


def _joined(parts: list[Column | str]) -> Column | str:
    """Parts one behind the other; known ones are one literal."""
    merged: list[Column | str] = []
    for p in parts:
        if isinstance(p, str) and merged and isinstance(merged[-1], str):
            merged[-1] += p
        elif not (isinstance(p, str) and not p):
            merged.append(p)
    if all(isinstance(p, str) for p in merged):
        return "".join(merged)
    return merged[0] if len(merged) == 1 else F.concat(*(F.lit(p) if isinstance(p, str) else p for p in merged))


def _text(x: Column | str) -> Any:
    return x if isinstance(x, str) else Expr(x, "text")


def _truth(x: Any) -> Column | bool:
    if not isinstance(x, Expr):
        return bool(x)
    if x.kind == "text":
        return F.coalesce(x.column != "", F.lit(False))
    if x.kind == "number":
        return F.coalesce(x.column != 0, F.lit(False))
    if x.kind == "flag":
        return F.coalesce(x.column, F.lit(False))
    if x.kind == "message":
        return x.column.isNotNull()
    return F.coalesce(F.size(x.column) > 0, F.lit(False))


def _flag(x: Column | bool) -> Any:
    return x if isinstance(x, bool) else Expr(x, "flag")


def _stripped(x: Column, left: bool = True, right: bool = True) -> Column:
    x = F.regexp_replace(x, rf"^[{WHITE_SPACE}]+", "") if left else x
    return F.regexp_replace(x, rf"[{WHITE_SPACE}]+\z", "") if right else x


_SAME_TEXT = {
    "trim": _stripped, "strip": _stripped, "lstrip": lambda x: _stripped(x, right=False), "rstrip": lambda x: _stripped(x, left=False), "upper": F.upper, "lower": F.lower, "string": lambda x: x,
}
_ORDER = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_SUMS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.FloorDiv: lambda a, b: F.floor(a / b), ast.Mod: lambda a, b: F.pmod(a, b)}


def _length(of: Expr) -> Expr:
    if of.kind == "text":
        return Expr(F.char_length(of.column), "number")
    if of.kind.startswith("list of "):
        return Expr(F.size(of.column), "number")
    raise Unsupported(f"length of a {of.kind}")


class _Run:
    """One run over a template's parts. If the fields of messages are whole, others are undefined, else not known."""

    def __init__(self, whole: bool):
        self.whole = whole

    def value(self, e: ast.expr, scope: dict[str, Any]) -> Any:
        match e:
            case ast.Constant() | ast.Name():
                return chat._value(e, scope)
            case ast.List() | ast.Tuple():
                return [self.value(x, scope) for x in e.elts]
            case ast.Attribute():
                return self._entry(self.value(e.value, scope), e.attr)
            case ast.Subscript(slice=ast.Slice()):
                return self._slice(self.value(e.value, scope), *(None if x is None else self.value(x, scope) for x in (e.slice.lower, e.slice.upper, e.slice.step)))
            case ast.Subscript():
                return self._entry(self.value(e.value, scope), self.value(e.slice, scope))
            case ast.BoolOp():
                return self._either([self.value(x, scope) for x in e.values], isinstance(e.op, ast.And))
            case ast.UnaryOp(op=ast.Not()):
                test = _truth(self.value(e.operand, scope))
                return not test if isinstance(test, bool) else _flag(~test)
            case ast.UnaryOp(op=ast.USub()):
                x = self.value(e.operand, scope)
                return Expr(-x.column, "number") if isinstance(x, Expr) else -x
            case ast.Compare():
                out: Any = True
                left = self.value(e.left, scope)
                for op, x in zip(e.ops, e.comparators, strict=True):
                    right = self.value(x, scope)
                    out = self._either([out, self._compare(type(op), left, right)], True)
                    left = right
                return out
            case ast.IfExp():
                test = _truth(self.value(e.test, scope))
                if isinstance(test, bool):
                    return self.value(e.body if test else e.orelse, scope)
                return _one(self.value(e.body, scope), self.value(e.orelse, scope), lambda a, b: F.when(test, a).otherwise(b))
            case ast.BinOp(op=ast.Mod(), right=ast.Name(id=name)) if name.partition("_")[2] in chat._TESTS:
                return self._test(self.value(e.left, scope), *name.split("_", 1))
            case ast.BinOp(op=ast.Pow()):
                out, steps = chat.filters(e)
                out = self.value(out, scope)
                for name, extra, named in steps:
                    out = self._filter(name, out, [self.value(x, scope) for x in extra], {k: self.value(x, scope) for k, x in named.items()})
                return out
            case ast.BinOp():
                return self._sum(type(e.op), self.value(e.left, scope), self.value(e.right, scope))
            case ast.Call(func=ast.Name(id="raise_exception")):
                return Expr(F.raise_error(_lift(self.value(e.args[0], scope)).column).cast("string"), "text")
            case ast.Call(func=ast.Name(id="namespace")):
                return Space({k.arg: self.value(k.value, scope) for k in e.keywords})
            case ast.Call(func=ast.Name(id=name)) if isinstance(scope.get(name), chat.Macro):
                macro = scope[name]
                given = macro.arguments([self.value(x, scope) for x in e.args], {k.arg: self.value(k.value, scope) for k in e.keywords}, lambda d: self.value(d, macro.scope))
                return _text(self.run(macro.body, {**macro.scope, **given}))
            case ast.Call(func=ast.Name(id="range")):
                limits = [self.value(x, scope) for x in e.args]
                if any(isinstance(x, Expr) for x in limits):
                    raise Unsupported("range of an expression")
                return list(range(*limits))
            case ast.Call(func=ast.Attribute(attr=name)):
                return self._method(self.value(e.func.value, scope), name, [self.value(x, scope) for x in e.args])
        raise Unsupported(ast.dump(e)[:60])

    def _entry(self, of: Any, key: Any) -> Any:
        if not isinstance(of, Expr):
            if isinstance(key, Expr):
                raise Unsupported("an entry named by an expression")
            return of.get(key) if isinstance(of, dict) else of[key] if isinstance(of, (list, str)) and isinstance(key, int) and -len(of) <= key < len(of) else None
        if of.kind == "message":
            if key in of.fields:
                return Expr(of.column[key], "text")
            if self.whole:
                return None
            raise Unsupported(f"the entry {key!r} of a message")
        if not of.kind.startswith("list of ") or isinstance(key, str):
            raise Unsupported(f"an entry of a {of.kind}")
        place = key.column if isinstance(key, Expr) else F.lit(key) if key >= 0 else F.size(of.column) + key
        return Expr(F.get(of.column, place), of.item, of.fields)

    def _slice(self, of: Any, lower: Any, upper: Any, step: Any) -> Any:
        if any(isinstance(x, Expr) for x in (lower, upper)):
            raise Unsupported("a slice by expressions")
        if not isinstance(of, Expr):
            return of[slice(lower, upper, step)]
        if step == -1 and lower is None and upper is None and of.kind.startswith("list of "):
            return Expr(F.reverse(of.column), of.kind, of.fields)
        if step not in (None, 1) or of.kind not in ("text", "list of message", "list of text"):
            raise Unsupported("this slice")
        size = F.char_length(of.column) if of.kind == "text" else F.size(of.column)
        at = lambda x, default: default if x is None else F.least(F.lit(x), size) if x >= 0 else F.greatest(size + x, F.lit(0))
        begin, end = at(lower, F.lit(0)), at(upper, size)
        cut = F.substring if of.kind == "text" else F.slice
        return Expr(cut(of.column, begin + 1, F.greatest(end - begin, F.lit(0))), of.kind, of.fields)

    def _either(self, values: list, all_: bool) -> Any:
        """`and` and `or`: the first value that decides, else the last."""
        *before, out = values
        for x in reversed(before):
            test = _truth(x)
            if isinstance(test, bool):
                out = out if test == all_ else x
            elif isinstance(out, bool) or (isinstance(out, Expr) and out.kind == "flag") or (isinstance(x, Expr) and x.kind == "flag" and not isinstance(out, Expr)):
                rest = F.lit(out) if isinstance(out, bool) else F.lit(bool(out)) if not isinstance(out, Expr) else _truth(out)
                out = _flag(test & rest if all_ else test | rest)
            elif isinstance(x, Expr) and x.kind == "flag":
                out = _flag(test & _truth(out) if all_ else test | _truth(out))
            else:
                out = _one(out, x, (lambda a, b, t=test: F.when(t, a).otherwise(b)) if all_ else (lambda a, b, t=test: F.when(t, b).otherwise(a)))
        return out

    def _compare(self, op: type, a: Any, b: Any) -> Any:
        if not isinstance(a, Expr) and not isinstance(b, Expr):
            if isinstance(b, list) and any(isinstance(x, Expr) for x in b):
                raise Unsupported("a list of expressions")
            return chat._COMPARE[op](a, b)
        if op in (ast.Eq, ast.NotEq):
            if a is None or b is None:
                same = _lift(a if b is None else b).column.isNull()
            elif _lift(a).kind != _lift(b).kind or _lift(a).kind not in ("text", "number", "flag"):
                raise Unsupported("a comparison of two kinds")
            else:
                same = _lift(a).column.eqNullSafe(_lift(b).column)
            return _flag(same if op is ast.Eq else ~same)
        if op in (ast.In, ast.NotIn):
            if isinstance(b, list):
                found = F.coalesce(_lift(a).column.isin(*b), F.lit(False)) if b else F.lit(False)
            elif isinstance(b, Expr) and b.kind == "message" and isinstance(a, str) and (self.whole or a in b.fields):
                # an entry that is null counts as missing, as for `is defined`
                found = b.column[a].isNotNull() if a in b.fields else F.lit(False)
            elif isinstance(b, dict) and all(isinstance(k, str) for k in b):
                found = F.coalesce(_lift(a).column.isin(*b), F.lit(False)) if b else F.lit(False)
            elif _lift(b).kind == "text" and _lift(a).kind == "text":
                found = F.coalesce(F.contains(_lift(b).column, _lift(a).column), F.lit(False))
            elif _lift(b).kind == "list of text" and _lift(a).kind == "text":
                found = F.coalesce(F.array_contains(b.column, _lift(a).column), F.lit(False))
            else:
                raise Unsupported("this membership")
            return _flag(found if op is ast.In else ~found)
        if _lift(a).kind != _lift(b).kind:
            raise Unsupported("a comparison of two kinds")
        return _flag(F.coalesce(_ORDER[op](_lift(a).column, _lift(b).column), F.lit(False)))

    def _test(self, x: Any, sign: str, name: str) -> Any:
        if not isinstance(x, Expr):
            found: Any = chat._TESTS[name](x)
        else:
            known = x.column.isNotNull()
            kinds = {"string": ("text",), "mapping": ("message",), "iterable": ("text", "message", *(k for k in (x.kind,) if k.startswith("list of ")))}
            found = ~known if name == "none" else known if name == "defined" or x.kind in kinds.get(name, ()) else F.lit(False)
        return (found if sign == "is" else not found) if isinstance(found, bool) else _flag(found if sign == "is" else ~found)

    def _filter(self, name: str, x: Any, extra: list, named: dict[str, Any]) -> Any:
        if name not in chat._FILTERS:
            raise chat.TemplateError(f"unknown filter {name!r}")
        if not isinstance(x, Expr):
            if any(isinstance(y, Expr) for y in [*extra, *named.values(), *(x if isinstance(x, list) else [])]):
                raise Unsupported("a filter with expressions")
            return chat._FILTERS[name](x, *extra, **named)
        if name in _SAME_TEXT and not extra:
            return Expr(_SAME_TEXT[name](_written(x) if name == "string" else self._of_text(x)), "text")
        if name == "length":
            return _length(x)
        if name == "default":
            return _one(x, extra[0] if extra else "", F.coalesce)
        if name == "list" and x.kind.startswith("list of "):
            return x
        if name in ("first", "last") and x.kind.startswith("list of "):
            return self._entry(x, 0 if name == "first" else -1)
        if name == "join" and x.kind == "list of text" and all(isinstance(y, str) for y in extra):
            return Expr(F.array_join(F.transform(x.column, lambda y: F.coalesce(y, F.lit("None"))), extra[0] if extra else ""), "text")
        raise Unsupported(f"the filter {name} of a {x.kind}")

    def _of_text(self, x: Expr) -> Column:
        if x.kind != "text":
            raise Unsupported(f"a {x.kind} as text")
        return x.column

    def _sum(self, op: type, a: Any, b: Any) -> Any:
        if not isinstance(a, Expr) and not isinstance(b, Expr):
            return a % b if op is ast.Mod else chat._ARITHMETIC[op](a, b)
        if op is ast.LShift:
            return _text(_joined([_written(a), _written(b)]))
        if op is ast.Add and any(x is None or _lift(x).kind == "text" for x in (a, b)):
            if any(x is not None and _lift(x).kind != "text" for x in (a, b)):
                raise Unsupported("a sum of two kinds")
            return _text(_joined([_written(a), _written(b)]))
        if op not in _SUMS or any(x is None or _lift(x).kind != "number" for x in (a, b)):
            raise Unsupported("this sum")
        return Expr(_SUMS[op](_lift(a).column, _lift(b).column), "number")

    def _method(self, of: Any, name: str, given: list) -> Any:
        if not isinstance(of, Expr):
            if any(isinstance(x, Expr) for x in given):
                raise Unsupported("a method with expressions")
            if of is None or name not in ("strip", "lstrip", "rstrip", "upper", "lower", "startswith", "endswith", "split", "replace", "title", "items", "get"):
                raise Unsupported(f"the method {name}")
            out = getattr(of, name)(*given)
            return list(out) if name == "items" else out
        if of.kind == "message" and name == "get" and isinstance(given[0], str):
            found = self._entry(of, given[0])
            return _one(found, given[1], F.coalesce) if len(given) > 1 else found
        column = self._of_text(of)
        if name in _SAME_TEXT and not given:
            return Expr(_SAME_TEXT[name](column), "text")
        if name in ("startswith", "endswith") and not isinstance(given[0], list):
            found = F.startswith if name == "startswith" else F.endswith
            return _flag(F.coalesce(found(column, _lift(given[0]).column), F.lit(False)))
        if name == "replace" and len(given) == 2:
            return Expr(F.replace(column, _lift(given[0]).column, _lift(given[1]).column), "text")
        if name == "split" and len(given) == 1 and isinstance(given[0], str) and given[0]:
            return Expr(F.split(column, escape(given[0]), -1), "list of text")
        raise Unsupported(f"the method {name}")

    # Statements

    def run(self, body: list, scope: dict[str, Any]) -> Column | str:
        parts: list[Column | str] = []
        for node in body:
            match node:
                case ("text", text):
                    parts.append(text)
                case ("out", e):
                    parts.append(_written(self.value(e, scope)))
                case ("set", name, e):
                    space, dot, key = name.partition(".")
                    if dot and not isinstance(scope.get(space), Space):
                        raise Unsupported("an entry of what is no namespace is set")
                    (scope[space] if dot else scope)[key if dot else name] = self.value(e, scope)
                case ("macro", name, *made):
                    scope[name] = chat.Macro(None, *made, scope)
                case ("if", arms):
                    parts.append(self._if(arms, scope))
                case ("for", names, over, inner, only, empty):
                    parts.append(self._for(names, self.value(over, scope), inner, only, empty, scope))
        return _joined(parts)

    def _if(self, arms: list, scope: dict[str, Any]) -> Column | str:
        if not arms:
            return ""
        (test, arm), *others = arms
        decided = _truth(self.value(test, scope))
        if isinstance(decided, bool):
            return self.run(arm, scope) if decided else self._if(others, scope)
        spaces = {n: s for n, s in scope.items() if isinstance(s, Space)}
        before = {n: Space(s) for n, s in spaces.items()}
        yes, no = dict(scope), dict(scope)
        for n, s in before.items():
            yes[n], no[n] = Space(s), Space(s)
        texts = self.run(arm, yes), self._if(others, no)
        choose = lambda a, b: F.when(decided, a).otherwise(b)
        pick = lambda a, b: a if a is b or (not isinstance(a, Expr) and not isinstance(b, Expr) and type(a) is type(b) and a == b) else _one(a, b, choose)
        for n in {*yes, *no}:
            a, b = yes.get(n), no.get(n)
            if n in spaces:
                spaces[n].update({k: pick(a.get(k), b.get(k)) for k in {*a, *b}})
            else:
                scope[n] = pick(a, b)
        return texts[0] if texts[0] is texts[1] else choose(*(F.lit(t) if isinstance(t, str) else t for t in texts))

    def _for(self, names: list[str], over: Any, body: list, only: ast.expr | None, empty: list, scope: dict[str, Any]) -> Column | str:
        if not isinstance(over, Expr):
            of = lambda item: dict(zip(names, item, strict=True)) if len(names) > 1 else {names[0]: item}
            items = []
            for x in over or []:
                keep = True if only is None else _truth(self.value(only, {**scope, **of(x)}))
                if not isinstance(keep, bool):
                    raise Unsupported("a known list filtered by expressions")
                items += [x] if keep else []
            parts = []
            for i, x in enumerate(items):
                loop = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1, "length": len(items), "previtem": items[i - 1] if i else None, "nextitem": items[i + 1] if i + 1 < len(items) else None}
                parts.append(self.run(body, {**scope, **of(x), "loop": loop}))
            return _joined(parts) if items else self.run(empty, scope)
        if len(names) > 1 or not over.kind.startswith("list of "):
            raise Unsupported(f"a loop over a {over.kind}")
        items = over.column
        item = lambda c: Expr(c, over.item, over.fields)
        if only is not None:
            keep = lambda x: _truth(self.value(only, {**scope, names[0]: item(x)}))
            items = F.filter(items, lambda x: k if not isinstance(k := keep(x), bool) else F.lit(k))
        length = F.size(items)

        def inside(x: Column, i: Column, spaces: dict[str, Space]) -> Column:
            loop = {
                "index0": Expr(i, "number"), "index": Expr(i + 1, "number"), "first": Expr(i == 0, "flag"), "last": Expr(i == length - 1, "flag"), "length": Expr(length, "number"),
                "previtem": item(F.get(items, i - 1)), "nextitem": item(F.get(items, i + 1)),
            }
            text = self.run(body, {**scope, **spaces, names[0]: item(x), "loop": loop})
            return F.lit(text) if isinstance(text, str) else text

        changed = sorted({(n, k) for n, k in self._sets(body) if isinstance(scope.get(n), Space)})
        fresh = lambda: {n: Space(s) for n, s in scope.items() if isinstance(s, Space)}
        if changed:
            out = self._fold(items, inside, changed, scope)
        else:
            out = F.array_join(F.transform(items, lambda x, i: inside(x, i, fresh())), "")
        if empty:
            other = self.run(empty, dict(scope))
            out = F.when(length > 0, out).otherwise(F.lit(other) if isinstance(other, str) else other)
        return out

    def _fold(self, items: Column, inside: Callable, changed: list[tuple[str, str]], scope: dict[str, Any]) -> Column:
        """A loop that sets these entries of namespaces: afterwards they are the fold's."""
        starts = [_lift(scope[n].get(k)) for n, k in changed]
        if any(s.kind not in ("text", "number", "flag") for s in starts):
            raise Unsupported("a namespace's entry of this kind")
        types = {"text": "string", "number": "long", "flag": "boolean"}
        state = lambda text, values: F.struct(text.alias("text"), *(v.cast(types[s.kind]).alias(f"v{i}") for i, (v, s) in enumerate(zip(values, starts, strict=True))))

        def step(s: Column, x: Column) -> Column:
            spaces = {n: Space(sp) for n, sp in scope.items() if isinstance(sp, Space)}
            for i, (n, k) in enumerate(changed):
                spaces[n][k] = Expr(s[f"v{i}"], starts[i].kind)
            text = inside(x["x"], x["i"], spaces)
            values = []
            for i, (n, k) in enumerate(changed):
                new = spaces[n][k]
                if new is not None and _lift(new).kind != starts[i].kind:
                    raise Unsupported("a namespace's entry changes its kind")
                values.append(F.lit(None) if new is None else _lift(new).column)
            return state(F.concat(s["text"], text), values)

        numbered = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        folded = F.aggregate(numbered, state(F.lit(""), [s.column for s in starts]), step)
        for i, (n, k) in enumerate(changed):
            scope[n][k] = Expr(folded[f"v{i}"], starts[i].kind)
        return folded["text"]

    def _sets(self, body: list) -> set[tuple[str, str]]:
        """Entries of namespaces that some statements set."""
        out: set[tuple[str, str]] = set()
        for node in body:
            match node:
                case ("set", name, _) if "." in name:
                    out.add(tuple(name.split(".", 1)))
                case ("if", arms):
                    out |= {x for _, arm in arms for x in self._sets(arm)}
                case ("for", _, _, inner, _, empty):
                    out |= self._sets(inner) | self._sets(empty)
        return out


def render(template: chat.Template, messages: Column, fields: tuple[str, ...] | None, context: dict[str, Any]) -> Column:
    """The text of each array of messages, structs with these text fields (None: role and content, and perhaps others); null for a null array. Raises
    Unsupported where the template is no expression."""
    known = Expr(messages, "list of message", ("role", "content") if fields is None else tuple(fields))
    text = _Run(fields is not None).run(template.body, {**context, "messages": known})
    return F.when(messages.isNotNull(), F.lit(text) if isinstance(text, str) else text)
