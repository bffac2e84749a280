"""Scalar functions and operators on single values, with None for missing."""

from __future__ import annotations

import math


def _strict(f):
    def rule(*a):
        if None in a:
            return None
        try:
            out = f(*a)
        except (ValueError, ZeroDivisionError, OverflowError):
            return None
        return None if out is None or out != out else float(out)

    return rule


def _half_away(x, digits=0.0):
    scale = 10.0 ** int(digits)
    return math.copysign(math.floor(abs(x * scale) + 0.5), x) / scale


def _sign(x):
    return (x > 0) - (x < 0)


POINTWISE = {
    "+": _strict(lambda x, y: x + y),
    "-": _strict(lambda x, y: x - y),
    "*": _strict(lambda x, y: x * y),
    "/": _strict(lambda x, y: x / y),
    "=": _strict(lambda x, y: x == y),
    "<>": _strict(lambda x, y: x != y),
    "<": _strict(lambda x, y: x < y),
    "<=": _strict(lambda x, y: x <= y),
    ">": _strict(lambda x, y: x > y),
    ">=": _strict(lambda x, y: x >= y),
    "and": _strict(lambda x, y: x != 0 and y != 0),
    "or": _strict(lambda x, y: x != 0 or y != 0),
    "not": _strict(lambda x: x == 0),
    "isnull": lambda x: float(x is None),
    "if": lambda c, a, b: a if c is None or c != 0 else b,
    "abs": _strict(abs),
    "acos": _strict(math.acos),
    "asin": _strict(math.asin),
    "atan": _strict(math.atan),
    "cos": _strict(math.cos),
    "sin": _strict(math.sin),
    "tan": _strict(math.tan),
    "exp": _strict(math.exp),
    "sqrt": _strict(math.sqrt),
    "pow": _strict(math.pow),
    "ln": _strict(math.log),
    "log": _strict(math.log10),
    "ceil": _strict(math.ceil),
    "ceiling": _strict(math.ceil),
    "floor": _strict(math.floor),
    "intpart": _strict(math.trunc),
    "facepart": _strict(math.trunc),
    "sign": _strict(_sign),
    "max": _strict(max),
    "min": _strict(min),
    "mod": _strict(lambda a, b: math.fmod(int(a), int(b))),
    "round": _strict(_half_away),
    "round2": _strict(_half_away),
    "between": _strict(lambda x, a, b: a <= x <= b),
    "range": lambda x, a, b: float(None not in (x, a, b) and a < x < b),
    "const": lambda x: x,
    "reverse": lambda x: x,
    "cost": lambda x: x,
}
