"""Functions of one bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.registry import NOTHING, missing, number, real, register, unless_zero


def _whole(x):
    """Toward zero."""
    return F.signum(x) * F.floor(F.abs(x))


for _name, _f in {
    "abs": F.abs,
    "acos": lambda x: real(F.acos(x)),
    "asin": lambda x: real(F.asin(x)),
    "atan": F.atan,
    "cos": F.cos,
    "sin": F.sin,
    "tan": F.tan,
    "exp": F.exp,
    "sqrt": lambda x: real(F.sqrt(x)),
    "ln": lambda x: real(F.ln(x)),
    "log": lambda x: real(F.log10(x)),
    "ceil": lambda x: number(F.ceil(x)),
    "floor": lambda x: number(F.floor(x)),
    "intpart": lambda x: number(_whole(x)),
    "facepart": lambda x: number(_whole(x)),
    "sign": F.signum,
    "const": lambda x: x,
    "reverse": lambda x: x,
    "not": lambda x: number(x == 0),
    "isnull": lambda x: number(x.isNull()),
}.items():
    register(_name, args=1)(_f)
register("ceiling", args=1)(lambda x: number(F.ceil(x)))


@register("pow", args=2)
def power(x, y):
    return real(F.pow(x, y))


@register("max", args=2)
def larger(a, b):
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


@register("min", args=2)
def smaller(a, b):
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


@register("mod", args=2)
def remainder(a, b):
    whole = b.cast("long")
    return F.when(whole != 0, number(F.try_mod(a.cast("long"), whole)))


def _rounded(x, digits):
    scale = F.pow(F.lit(10.0), number(_whole(digits)))
    y = x * scale
    return F.signum(y) * F.floor(F.abs(y) + 0.5) / scale


@register("round", args=(1, 2))
def rounded(x, digits=None):
    return _rounded(x, F.lit(0.0) if digits is None else digits)


register("round2", args=2)(_rounded)


@register("between", args=3)
def between(x, low, high):
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), number(x.between(low, high)))


@register("range", args=3)
def strictly_between(x, low, high):
    return number(F.coalesce((x > low) & (x < high), F.lit(False)))


@register("cost", args=(0, 1))
def cost(x=None):
    return F.col("close") if x is None else x


@register("if", args=3)
def choose(test, a, b):
    return F.when(unless_zero(test), a).otherwise(b)


@register("rand")
def rand():
    return F.rand(42)


# Names that take arguments but calculate nothing, and give a missing value.
for _names, _args in (
    (("currbarscount", "totalrange", "lfs"), 0),
    (("refdate", "beta", "forcast", "downnday", "nday", "upnday"), 2),
    (("costex",), (0, 2)),
    (("lwinner", "ppart", "pwinner", "winner"), (0, 1)),
    (("newsar", "sar", "sarturn"), (0, 4)),
    (("ifc", "iff", "ifn", "betax", "relate"), 3),
    (("testskip",), 1),
):
    register(*_names, args=_args)(lambda *_: missing())
    NOTHING.update(_names)
