"""Ordered folds: recursive columns of one stage in one pass over each instrument's bars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.functions.barwise import RULES, rule_of
from tickloom.plans.compiler import Fold


def series(values: np.ndarray) -> list:
    return [None if v != v else v for v in values.tolist()]


def reader(values: list):
    n = len(values)
    return lambda j: values[j] if 0 <= j < n else None


def folded(name: str, args: list, bars: int) -> np.ndarray:
    """A rule run over all bars; args: lists of values or constants."""
    rule, out = rule_of(name), []
    reads = [reader(a) if isinstance(a, list) else (lambda j, v=a: v) for a in args]
    own = lambda j: out[j] if j >= 0 else None
    for i in range(bars):
        out.append(rule(reads, i, own))
    result = np.array([np.nan if v is None else v for v in out], dtype=np.float64)
    if name == "totalbarscount":
        result[:] = bars
    if name == "islastbar":
        result[:-1] = 0
    return result


def apply_folds(df: DataFrame, folds: list[Fold], key: str) -> DataFrame:
    """df with a column for each fold. Bars of an instrument go through one task; instruments are spread.

    Rows keep all their columns; missing values are null.
    """
    for f in folds:
        if f.rule not in RULES:
            raise ValueError(f"{f.rule} has no rule bar by bar")
    fields = [*df.schema.fields, *(T.StructField(f.out, T.DoubleType()) for f in folds)]

    def run(table):
        import pyarrow as pa

        n = table.num_rows
        at = table.column("_i").to_numpy()
        rank = np.argsort(at, kind="stable")
        back = np.empty(n, np.int64)
        back[rank] = np.arange(n)
        for f in folds:
            args = [series(table.column(a).to_numpy(zero_copy_only=False).astype(np.float64)[rank]) if isinstance(a, str) else a for a in f.args]
            got = folded(f.rule, args, n)[back]
            table = table.append_column(f.out, pa.array(got, pa.float64(), mask=np.isnan(got)))
        return table

    return df.groupBy(key).applyInArrow(run, T.StructType(fields))

