"""Scripts over tables of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.registry import Frames
from tickloom.operators.folds import apply_folds
from tickloom.plans.compiler import INPUTS, Compiler, Plan
from tickloom.plans.parse import parse
from tickloom.plans.tree import Script, ScriptError


def _prepared(bars: DataFrame, inputs: list[str]) -> DataFrame:
    """Inputs as doubles with NaN as missing; time and date as numbers where a script reads them."""
    out = {}
    for c in inputs:
        kind = bars.schema[c].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            out[c] = F.unix_timestamp(F.col(c).cast("timestamp")).cast("double") if c == "time" else F.date_format(c, "yyyyMMdd").cast("double")
        elif isinstance(kind, T.DateType):
            out[c] = F.date_format(c, "yyyyMMdd").cast("double")
        else:
            out[c] = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return bars.withColumns(out) if out else bars


def plan(script: str | Script, columns: list[str], language: str = "hithink", order=None, parameters: dict | None = None, weighted_sma: bool = False, split=None) -> Plan:
    """Compile a script for bars with these columns, without running anything."""
    tree = parse(script, language) if isinstance(script, str) else script
    return Compiler(tree, [c for c in columns if c in set(INPUTS.values())], Frames(order or Window.orderBy("time"), split), parameters, weighted_sma).compile()


def run(bars: DataFrame, script: str | Script, language: str = "hithink", symbol: str | None = None, time: str = "time", ties: tuple[str, ...] = (), parameters: dict | None = None, keep: tuple[str, ...] = (), weighted_sma: bool = False, missing_first: bool = False) -> DataFrame:
    """The script's outputs for every bar: symbol, time, ties, columns in `keep`, then the outputs.

    symbol: the column that tells instruments apart, each of which has a history of its own; without it all bars are
    one instrument, in one task. time and ties order the bars (null times last); bars that agree on them have no order,
    so `ties` should make it total. The script reads close, open, high, low, volume, amount, date and time.
    parameters: values for the script's inputs. weighted_sma: sma(x, n, m) as (m * x + (n - m) * before) / n rather
    than the plain mean. A script without outputs gives the keys alone.
    """
    keys = [c for c in dict.fromkeys([*([symbol] if symbol else []), time, *ties, *keep]) if c in bars.columns]
    df = bars.select(*[F.col(c).alias(f"_key{k}") for k, c in enumerate(keys)], *[c for c in bars.columns if c in set(INPUTS.values())])
    at = {c: f"_key{k}" for k, c in enumerate(keys)}
    if time not in at:
        raise ScriptError(f"the bars have no column {time!r} to order them by")
    df = df.withColumn("_symbol", F.col(at[symbol]) if symbol else F.lit(0))
    null_last = F.col(at[time]).asc_nulls_first() if missing_first else F.col(at[time]).asc_nulls_last()
    order = Window.partitionBy("_symbol").orderBy(null_last, *[F.col(at[t]) for t in ties])
    made = plan(script, df.columns, language, order, parameters, weighted_sma, lambda c: Window.partitionBy("_symbol", c).orderBy("_i"))
    df = _prepared(df, made.inputs).select(*at.values(), "_symbol", *made.inputs)
    if made.needs_index or any(s.folds for s in made.stages):
        df = df.withColumn("_i", F.row_number().over(order) - 1)
    for stage in made.stages:
        if stage.columns:
            df = df.withColumns(stage.columns)
        if stage.folds:
            df = apply_folds(df, stage.folds, "_symbol")
    taken = {c.lower() for c in keys}
    for o in made.outputs:
        if o.name.lower() in taken:
            raise ScriptError(f"the output {o.name!r} has the name of another column of the result")
        taken.add(o.name.lower())
    return df.select(*[F.col(v).alias(k) for k, v in at.items()], *[o.term.column.cast("double").alias(o.name) for o in made.outputs])


def screen(result: DataFrame, flag: str = "select") -> DataFrame:
    """The bars where a flag that a script selected is set."""
    return result.where(F.coalesce(F.col(flag) != 0, F.lit(False)))


def with_lookback(bars: DataFrame, start, end, script: str | Script, lookback: int, language: str = "hithink", symbol: str | None = None, time: str = "time", ties: tuple[str, ...] = (), **options) -> DataFrame:
    """run() for bars from start to end, reading only the `lookback` bars before start that its windows reach."""
    w = Window.partitionBy(symbol) if symbol else Window.partitionBy(F.lit(0))
    before = bars.where(F.col(time) < F.lit(start))
    near = before.withColumn("_back", F.row_number().over(w.orderBy(F.col(time).desc(), *[F.col(t).desc() for t in ties]))).where(F.col("_back") <= lookback).drop("_back")
    inside = bars.where((F.col(time) >= F.lit(start)) & (F.col(time) <= F.lit(end)))
    return run(near.unionByName(inside), script, language, symbol, time, ties, **options).where(F.col(time) >= F.lit(start))
