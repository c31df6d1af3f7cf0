"""The condition language: texts such as "rsi < 30 and close > sma(close, 20)" as boolean columns.

Comparisons (also chained), and / or / not, + - * / %, unary minus, numbers, column names and sma(x, n). Anything
else, and unknown names, give a condition that is never true; `problems` says why. Null never signals.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import add, and_, ge, gt, le, lt, mod, mul, or_, sub

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rolling as W


# The published predicates that a strategy search draws from, by side.
ENTRY_POOL = {
    "long": (
        "rsi < 30", "rsi < 35", "macd_histogram > 0", "close > bollinger_lower", "close > ema_fast", "ema_fast > ema_slow",
        "volume_ratio > 1.5", "volume_ratio > 2.0", "adx > 20", "adx > 25", "stoch_k < 20", "stoch_k > stoch_d", "cci < -100",
        "cci < -200", "atr_ratio > 1.5", "obv > obv_sma", "close > sma",
    ),
    "short": (
        "rsi > 70", "rsi > 65", "macd_histogram < 0", "close < bollinger_upper", "close < ema_fast", "ema_fast < ema_slow",
        "volume_ratio > 1.5", "volume_ratio > 2.0", "adx > 20", "adx > 25", "stoch_k > 80", "stoch_k < stoch_d", "cci > 100",
        "cci > 200", "atr_ratio < 0.7", "obv < obv_sma", "close < sma",
    ),
}
EXIT_POOL = {
    "long": (
        "rsi > 65", "rsi > 55", "close < bollinger_middle", "close < ema_slow", "close < bollinger_lower", "stoch_k > 75",
        "cci > 150", "close < sma",
    ),
    "short": (
        "rsi < 35", "rsi < 45", "close > bollinger_middle", "close > ema_slow", "close > bollinger_upper", "stoch_k < 25",
        "cci < -150", "close > sma",
    ),
}


class ConditionError(ValueError):
    pass


_COMPARE: dict[type, Callable] = {ast.Lt: lt, ast.LtE: le, ast.Gt: gt, ast.GtE: ge, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
_ARITHMETIC: dict[type, Callable] = {ast.Add: add, ast.Sub: sub, ast.Mult: mul, ast.Div: F.try_divide, ast.Mod: mod}


def _parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ConditionError(f"not a condition: {text!r}") from e


def names_in(text: str) -> set[str]:
    """Column names that a condition refers to; none if it can't be parsed."""
    try:
        tree = _parse(text)
    except ConditionError:
        return set()
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


def _build(node: ast.expr, columns: frozenset[str]) -> Column:
    sub_ = lambda n: _build(n, columns)
    match node:
        case ast.Constant(value=bool(v)) | ast.Constant(value=int(v)) | ast.Constant(value=float(v)):
            return F.lit(v)
        case ast.Name(id=name):
            if name not in columns:
                raise ConditionError(f"unknown column {name}")
            return F.col(name)
        case ast.BoolOp(op=op, values=values):
            return reduce(and_ if isinstance(op, ast.And) else or_, map(sub_, values))
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return ~sub_(x)
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -sub_(x)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
            return _ARITHMETIC[type(op)](sub_(a), sub_(b))
        case ast.Compare(left=first, ops=ops, comparators=rest) if all(type(o) in _COMPARE for o in ops):
            sides = [sub_(x) for x in (first, *rest)]
            return reduce(and_, (_COMPARE[type(o)](a, b) for o, a, b in zip(ops, sides, sides[1:], strict=False)))
        case ast.Call(func=ast.Name(id="sma"), args=[x, ast.Constant(value=int(n))], keywords=[]) if n > 0:
            return W.mean(sub_(x), n)
    raise ConditionError(f"{ast.unparse(node)} is not part of the language")


def compile_condition(text: str, columns: Iterable[str]) -> Column:
    """The condition as a column that is true or false, never null; false throughout if it is invalid."""
    try:
        return F.coalesce(_build(_parse(text), frozenset(columns)), F.lit(False))
    except ConditionError:
        return F.lit(False)


def problems(texts: Iterable[str], columns: Iterable[str]) -> dict[str, str]:
    """Why conditions are invalid, each once."""
    known, out = frozenset(columns), {}
    for text in dict.fromkeys(texts):
        try:
            _build(_parse(text), known)
        except ConditionError as e:
            out[text] = str(e)
    return out


def combine(texts: Sequence[str], columns: Iterable[str], how: str = "and") -> Column:
    """All conditions ("and") or any ("or"); false if there is none."""
    known = frozenset(columns)
    if not texts:
        return F.lit(False)
    return reduce(and_ if how == "and" else or_, (compile_condition(t, known) for t in texts))


def sanitise(texts: Sequence[str], columns: Iterable[str], fallback: str) -> list[str]:
    """Conditions whose columns are all there; the fallback if none is left."""
    known = {*columns}
    kept = [t for t in texts if names_in(t) and names_in(t) <= known]
    return kept or [fallback]
