"""A small expression language compiled to Spark columns.

Numbers, strings, names, ``+ - * / %``, comparisons, ``&& || !``, ``cond ? a : b``, calls of max,
min, abs, ceil, floor, of hour, minute, weekday, month and day of a time zone, of ``has(text, part)``,
``param(path)`` and ``header(name)``, and ``tier(name, value)``, which gives the value and records
the name of the branch that gave it. A prefix ``v1:`` is allowed. The whole expression becomes one
column, so that it runs inside generated code; a second column tells the tier.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[A-Za-z_]\w*)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<op>\|\||&&|==|!=|<=|>=|\?\?|[-+*/%<>!?:(),]))""")
_POWER = {"||": 2, "&&": 3, "==": 4, "!=": 4, "<": 5, "<=": 5, ">": 5, ">=": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}
CALLS = {"max": 2, "min": 2, "abs": 1, "ceil": 1, "floor": 1, "hour": 1, "minute": 1, "weekday": 1, "month": 1, "day": 1, "has": 2, "param": 1, "header": 1, "tier": 2}


@dataclass(frozen=True)
class Node:
    kind: str  # num, str, name, un, bin, if, call
    value: object = None
    parts: tuple["Node", ...] = ()


@lru_cache(maxsize=256)
def parse(source: str) -> Node:
    """The syntax tree; SyntaxError where the source isn't an expression."""
    source = source.removeprefix("v1:")
    tokens, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise SyntaxError(f"unexpected {source[at : at + 10]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek() -> tuple[str, str]:
        return tokens[place]

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal place
        got = tokens[place]
        if want is not None and got[1] != want:
            raise SyntaxError(f"expected {want!r}, got {got[1]!r}")
        place += 1
        return got

    def atom() -> Node:
        kind, text = take()
        if kind == "num":
            return Node("num", float(text))
        if kind == "str":
            return Node("str", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "name":
            if peek()[1] != "(":
                return Node("num", 1.0 if text == "true" else 0.0) if text in ("true", "false") else Node("name", text)
            take("(")
            args = []
            while peek()[1] != ")":
                args.append(expression(0))
                if peek()[1] == ",":
                    take()
            take(")")
            if CALLS.get(text) != len(args):
                raise SyntaxError(f"no function {text} of {len(args)} arguments")
            return Node("call", text, tuple(args))
        if text == "(":
            inner = expression(0)
            take(")")
            return inner
        if text in ("-", "+", "!"):
            return Node("un", text, (expression(8),))
        raise SyntaxError(f"unexpected {text!r}")

    def expression(least: int) -> Node:
        left = atom()
        while True:
            _, op = peek()
            if op == "?" and least <= 1:
                take()
                yes = expression(0)
                take(":")
                left = Node("if", None, (left, yes, expression(1)))
            elif op in _POWER and _POWER[op] > least:
                take()
                left = Node("bin", op, (left, expression(_POWER[op])))
            else:
                return left

    tree = expression(0)
    if peek()[0] != "end":
        raise SyntaxError(f"unexpected {peek()[1]!r}")
    return tree


def names(tree: Node) -> set[str]:
    """Variables that an expression uses."""
    return ({tree.value} if tree.kind == "name" else set()).union(*(names(p) for p in tree.parts), set())


@dataclass(frozen=True)
class Scope:
    """What an expression may look at: its variables, the moment, a JSON body and a map of headers."""

    variables: dict[str, Column]
    now: Column | None = None
    body: Column | None = None
    headers: Column | None = None


def compile_columns(source: str, scope: Scope) -> tuple[Column, Column]:
    """(value, tier): the expression's value as double and the name of the tier it came from, null without one."""
    tree = parse(source)
    unknown = names(tree) - set(scope.variables)
    if unknown:
        raise NameError(f"unknown: {', '.join(sorted(unknown))}")
    return _value(tree, scope).cast("double"), _tier(tree, scope)


def _truth(node: Node, scope: Scope) -> Column:
    value = _value(node, scope)
    boolean = (node.kind == "bin" and node.value in ("||", "&&", "==", "!=", "<", "<=", ">", ">=")) or (node.kind == "un" and node.value == "!") or (node.kind == "call" and node.value == "has")
    return value if boolean else value != 0


def _value(node: Node, scope: Scope) -> Column:
    if node.kind in ("num", "str"):
        return F.lit(node.value)
    if node.kind == "name":
        return scope.variables[node.value].cast("double")
    if node.kind == "if":
        test, yes, no = node.parts
        return F.when(_truth(test, scope), _value(yes, scope)).otherwise(_value(no, scope))
    if node.kind == "un":
        if node.value == "!":
            return ~_truth(node.parts[0], scope)
        inner = _value(node.parts[0], scope)
        return -inner if node.value == "-" else inner
    if node.kind == "bin":
        a, b = node.parts
        if node.value in ("&&", "||"):
            x, y = _truth(a, scope), _truth(b, scope)
            return x & y if node.value == "&&" else x | y
        x, y = _value(a, scope), _value(b, scope)
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.when(y != 0, x % y), "==": lambda: x.eqNullSafe(y), "!=": lambda: ~x.eqNullSafe(y), "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[node.value]()
    name, args = node.value, node.parts
    if name == "tier":
        return _value(args[1], scope)
    if name in ("hour", "minute", "weekday", "month", "day"):
        zone = str(args[0].value or "").strip() or "UTC"
        at = F.from_utc_timestamp(scope.now, zone)
        return {"hour": F.hour, "minute": F.minute, "month": F.month, "day": F.dayofmonth, "weekday": lambda c: F.dayofweek(c) - 1}[name](at)
    if name == "param":
        return F.get_json_object(scope.body, "$." + str(args[0].value).strip())
    if name == "header":
        return F.coalesce(F.element_at(scope.headers, str(args[0].value).strip().lower()), F.lit(""))
    if name == "has":
        part = _value(args[1], scope)
        return F.coalesce((part != "") & F.contains(_value(args[0], scope).cast("string"), part), F.lit(False))
    values = [_value(a, scope) for a in args]
    return {"max": F.greatest, "min": F.least, "abs": F.abs, "ceil": F.ceil, "floor": F.floor}[name](*values)


def _tier(node: Node, scope: Scope) -> Column:
    """The last tier taken, in order of evaluation."""
    if node.kind == "call" and node.value == "tier":
        return F.lit(node.parts[0].value)
    if node.kind == "if":
        test, yes, no = node.parts
        return F.when(_truth(test, scope), _tier(yes, scope)).otherwise(_tier(no, scope))
    found = [_tier(p, scope) for p in node.parts if _has_tier(p)]
    return F.coalesce(*reversed(found)) if found else F.lit(None).cast("string")


def _has_tier(node: Node) -> bool:
    return node.kind == "call" and node.value == "tier" or any(map(_has_tier, node.parts))
