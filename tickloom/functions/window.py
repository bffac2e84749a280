"""Functions over a fixed number of bars. Each says what it does with missing values and short histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.registry import missing, number, register, true


def _full(names: tuple[str, ...], what, least: int = 1):
    """Missing unless all n values are there."""
    register(*names, args=2, kind="window", lengths=(1,))(lambda w, x, n: F.when(w.full(x, n), what(w, x, n)) if n >= least else missing())


_over = lambda f: lambda w, x, n: f(x).over(w.last(n))
_full(("ma", "average"), _over(F.avg))
_full(("sum", "sumbars"), _over(F.sum))
_full(("std", "stddev"), _over(F.stddev_samp), 2)
_full(("var",), _over(F.var_samp), 2)
_full(("stdp",), _over(F.stddev_pop))
_full(("varp",), _over(F.var_pop))
_full(("slope",), lambda w, x, n: F.regr_slope(x, number(w.i)).over(w.last(n)), 2)
# The weight of the smoothing is taken and not used: the plain mean.
register("sma", args=3, kind="window", lengths=(1,))(lambda w, x, n, m: F.when(w.full(x, n), F.avg(x).over(w.last(n))) if n >= 1 else missing())


@register("ta.sma", args=2, kind="window", lengths=(1,))
def pine_sma(w, x, n):
    return F.when(w.i >= n - 1, F.avg(x).over(w.last(n))) if n >= 1 else missing()


@register("wma", args=2, kind="window", lengths=(1,))
def wma(w, x, n):
    if n < 1:
        return missing()
    values = F.transform(F.collect_list(x).over(w.last(n)), lambda v, k: v * (k + 1))
    return F.when(w.full(x, n), F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / (n * (n + 1) / 2))


@register("mular", args=2, kind="window", lengths=(1,))
def product(w, x, n):
    if n == 0:
        return F.when(F.count(x).over(w.cum) == w.i + 1, F.product(x).over(w.cum))
    return F.when(w.full(x, n), F.product(x).over(w.last(n))) if n > 0 else F.lit(1.0)


@register("count", args=2, kind="window", lengths=(1,))
def count(w, c, n):
    return number(F.sum(true(c).cast("int")).over(w.last(n))) if n >= 1 else F.lit(0.0)


@register("exist", "tfilter", args=2, kind="window", lengths=(1,))
def exist(w, c, n):
    return number(F.max(true(c).cast("int")).over(w.last(n))) if n >= 1 else F.lit(0.0)


@register("tfilt", args=2, kind="window", lengths=(1,))
def all_there(w, c, n):
    return number(F.min(true(c).cast("int")).over(w.last(n))) if n >= 1 else F.lit(1.0)


@register("every", args=2, kind="window", lengths=(1,))
def every(w, c, n):
    return number((w.i >= n - 1) & (F.min(true(c).cast("int")).over(w.last(n)) == 1)) if n >= 1 else F.lit(1.0)


register("hhv", args=2, kind="window", lengths=(1,))(lambda w, x, n: F.max(x).over(w.last(n)) if n >= 1 else missing())
register("llv", args=2, kind="window", lengths=(1,))(lambda w, x, n: F.min(x).over(w.last(n)) if n >= 1 else missing())
register("hv", args=2, kind="window", lengths=(1,))(lambda w, x, n: F.max(x).over(w.rows(-n, -1)) if n >= 1 else missing())
register("lv", args=2, kind="window", lengths=(1,))(lambda w, x, n: F.min(x).over(w.rows(-n, -1)) if n >= 1 else missing())


def _bars_since_extreme(sign):
    def build(w, x, n):
        if n < 1:
            return F.lit(-1.0)
        first = F.min_by(w.i, F.when(x.isNotNull(), F.struct(x * sign, w.i))).over(w.last(n))
        return number(F.coalesce(w.i - first, F.lit(-1)))

    return build


register("hhvbars", args=2, kind="window", lengths=(1,))(_bars_since_extreme(-1.0))
register("llvbars", args=2, kind="window", lengths=(1,))(_bars_since_extreme(1.0))


def _nth_extreme(descending: bool, position: bool):
    def build(w, x, n, m, t):
        if m < 1 or t < 1:
            return missing()
        sign = -1.0 if descending else 1.0
        key = F.when(x.isNotNull(), F.struct((x * sign).alias("k"), w.i.alias("i")))
        got = F.get(F.array_sort(F.collect_list(key).over(w.rows(-(n + m - 1), -n))), F.lit(t - 1))
        return number(w.i - got["i"]) if position else got["k"] * sign

    return build


register("findhigh", args=4, kind="window", lengths=(1, 2, 3))(_nth_extreme(True, False))
register("findlow", args=4, kind="window", lengths=(1, 2, 3))(_nth_extreme(False, False))
register("findhighbars", args=4, kind="window", lengths=(1, 2, 3))(_nth_extreme(True, True))
register("findlowbars", args=4, kind="window", lengths=(1, 2, 3))(_nth_extreme(False, True))


@register("ref", "refv", "hod", "lod", "lowrange", args=2, kind="window", lengths=(1,))
def ref(w, x, n):
    return F.lag(x, n).over(w.o) if n > 0 else F.lead(x, -n).over(w.o) if n < 0 else x


@register("tma", args=2, kind="composed")
def tma(call, x, n):
    return call("ma", call("ma", x, n), n)


@register("avedev", args=2, kind="window", lengths=(1,))
def avedev(w, x, n):
    if n < 1:
        return missing()
    # The mean is bound once, as the only element of an array.
    dev = lambda v: F.aggregate(v["a"], F.lit(0.0), lambda s, e: s + F.abs(e - v["m"])) / F.size(v["a"])
    both = F.array(F.struct(F.collect_list(x).over(w.last(n)).alias("a"), F.avg(x).over(w.last(n)).alias("m")))
    return F.when(F.count(x).over(w.last(n)) > 0, F.get(F.transform(both, dev), F.lit(0)))


@register("devsq", args=2, kind="window", lengths=(1,))
def devsq(w, x, n):
    return F.var_pop(x).over(w.last(n)) * F.count(x).over(w.last(n)) if n >= 1 else missing()


@register("covar", args=3, kind="window", lengths=(2,))
def covar(w, x, y, n):
    return F.when(w.full(x + y, n), F.covar_samp(x, y).over(w.last(n))) if n >= 2 else missing()


@register("last", args=3, kind="window", lengths=(1, 2))
def last(w, c, a, b):
    b = b or 1
    if a == 0:  # from the first bar on: nothing lies between once b bars have passed
        at_first = F.first(true(c)).over(w.cum)
        return F.when(w.i > b, F.lit(1.0)).when(w.i == b, number(at_first)).otherwise(F.lit(0.0))
    if a > b:
        return F.lit(1.0)
    frame = w.rows(-b, -a)
    return number((F.count(F.lit(1)).over(frame) == b - a + 1) & (F.coalesce(F.min(true(c).cast("int")).over(frame), F.lit(0)) == 1))


def _crossing(both_ways: bool):
    def build(w, a, b):
        # The value before of a constant is the constant.
        pa, pb = (t.column if t.constant is not None else F.lag(t.column).over(w.o) for t in (a, b))
        a, b = a.column, b.column
        hit = (a > b) & (pa <= pb)
        if both_ways:
            hit = hit | ((a < b) & (pa >= pb))
        return number(F.coalesce(hit, F.lit(False)))

    return build


register("cross", args=2, kind="terms")(_crossing(True))
register("longcross", args=2, kind="terms")(_crossing(False))
