"""Functions over all bars so far: counters and values that are carried forward."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.registry import number, register, true, unless_zero


@register("barscount", args=1, kind="window")
def barscount(w, x):
    return number(F.count(x).over(w.cum))


@register("barslast", args=1, kind="window")
def barslast(w, c):
    return number(w.i - F.last(F.when(true(c), w.i), ignorenulls=True).over(w.cum))


@register("barssince", args=1, kind="window")
def barssince(w, c):
    return number(F.coalesce(w.i - F.last(F.when(true(c), w.i), ignorenulls=True).over(w.cum), F.lit(-1)))


@register("barssincen", args=2, kind="composed")
def barssincen(call, c, n):
    # Among true bars alone the sought one is n - 1 rows back, or the first; other bars carry it forward.
    return call("_carried", call("_true_before", c, n))


@register("_true_before", args=2, kind="window", lengths=(1,))
def true_before(w, c, n):
    among = w.split(true(c))
    first = F.first(w.i).over(among.rowsBetween(Window.unboundedPreceding, 0))
    return number(F.when(true(c), F.coalesce(F.lag(w.i, max(n, 1) - 1).over(among) if n > 1 else w.i, first)))


@register("_carried", args=1, kind="window")
def carried(w, j):
    return number(F.coalesce(w.i - F.last(j, ignorenulls=True).over(w.cum), F.lit(-1)))


@register("barslastcount", "barsstatus", args=1, kind="window")
def run_length(w, c):
    return number(w.i - F.coalesce(F.last(F.when(~true(c), w.i), ignorenulls=True).over(w.cum), F.lit(-1)))


@register("valuewhen", args=2, kind="window")
def valuewhen(w, c, x):
    # The struct keeps a missing x apart from no value at all.
    return F.last(F.when(unless_zero(c), F.struct(x.alias("x"))), ignorenulls=True).over(w.cum)["x"]


@register("totalbarscount", kind="window")
def totalbarscount(w):
    return number(F.count(F.lit(1)).over(w.all))


@register("islastbar", kind="window")
def islastbar(w):
    return number(w.i == F.max(w.i).over(w.all))
