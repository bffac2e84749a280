"""Names of functions, how many arguments they take, and how they become columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Function:
    """kind: scalar (columns in, column out), window (frames over the bar order), composed (of other calls), fold.

    lengths: arguments that frames need as constants; with a series there the call becomes a fold.
    """

    name: str
    least: int
    most: int
    kind: str
    build: Callable | None
    lengths: tuple[int, ...] = ()


REGISTRY: dict[str, Function] = {}
#: Names that take arguments but calculate nothing.
NOTHING: set[str] = set()


def calculates_nothing(name: str) -> bool:
    return name in NOTHING


def register(*names: str, args: int | tuple[int, int] = 0, kind: str = "scalar", lengths: tuple[int, ...] = (), pointwise: Callable | None = None):
    """Register a builder under names; users add functions of their own with it.

    A scalar builder takes Columns (doubles). A window builder takes a Frames and then Columns, with ints for lengths.
    pointwise: the same for the numbers of one bar (None if missing), which streams use; without it a stream refuses
    the name.
    """
    least, most = args if isinstance(args, tuple) else (args, args)

    def add(build: Callable) -> Callable:
        for n in names:
            REGISTRY[n] = Function(n, least, most, kind, build, lengths)
            NOTHING.discard(n)
            if pointwise:
                from tickloom.plans.pointwise import POINTWISE

                POINTWISE[n] = pointwise
        return build

    return add



def missing() -> Column:
    return F.lit(None).cast("double")


def number(c: Column) -> Column:
    return c.cast("double")


def true(c: Column) -> Column:
    """The test of conditions in windows: missing is false."""
    return F.coalesce(c != 0, F.lit(False))


def unless_zero(c: Column) -> Column:
    """The test of if and valuewhen: missing is true."""
    return F.coalesce(c != 0, F.lit(True))


def real(c: Column) -> Column:
    """NaN, which some functions give outside their domain, as missing."""
    return F.when(~F.isnan(c), c)


class Frames:
    """The one order of bars within an instrument, and frames over it."""

    def __init__(self, order, split=None) -> None:
        """split: gives the order within the bars of an instrument that agree on a column."""
        from pyspark.sql import Window

        self.o, self.i = order, F.col("_i")
        self.split = split or (lambda c: Window.partitionBy(c).orderBy("_i"))
        self.cum = order.rowsBetween(Window.unboundedPreceding, 0)
        self.all = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def last(self, n: int):
        return self.o.rowsBetween(-(n - 1), 0)

    def rows(self, a: int, b: int):
        return self.o.rowsBetween(a, b)

    def full(self, x: Column, n: int) -> Column:
        return F.count(x).over(self.last(n)) == n
