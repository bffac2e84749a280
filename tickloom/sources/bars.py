"""Bars: a DataFrame of time (seconds since 1970), date (YYYYMMDD), open, high, low, close, volume, amount, all doubles.

Readers are lazy and give missing values as nulls; null_as_zero gives 0 for them instead. Row order means nothing:
scripts order bars by time.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
#: The field numbers of the numbered JSON dialects.
FIELDS = {"open": "7", "high": "8", "low": "9", "close": "11", "volume": "13", "amount": "19"}


class Source(Protocol):
    """What gives bars to a script."""

    def load(self, spark: SparkSession) -> DataFrame: ...


def _missing(c: Column, null_as_zero: bool) -> Column:
    c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return F.coalesce(c, F.lit(0.0)) if null_as_zero else c


def _stamps(at: Column) -> list[Column]:
    return [F.unix_timestamp(at).cast("double").alias("time"), F.date_format(at, "yyyyMMdd").cast("double").alias("date")]


def mock(spark: SparkSession, bars: int = 1000) -> DataFrame:
    """Deterministic bars, one a minute."""
    k = F.col("id")
    # The recipe of the generated bars.
    close = F.lit(100.0) + 0.5 * (k % 20 - 10)
    first = close - 0.1 * (k % 5 - 2)
    return spark.range(bars).select(
        (F.lit(1672531200.0) + 60 * k).alias("time"),
        first.alias("open"),
        (F.greatest(first, close) + 0.05 * (k % 3)).alias("high"),
        (F.least(first, close) - 0.05 * (k % 3)).alias("low"),
        close.alias("close"),
        (F.lit(1000.0) + 100 * (k % 5)).alias("volume"),
    )


def csv(spark: SparkSession, path: str, null_as_zero: bool = False, extra: str = "") -> DataFrame:
    """CSV with a header and the columns time, open, high, low, close in this order (`extra`: DDL of further ones)."""
    schema = "time timestamp, open double, high double, low double, close double" + (f", {extra}" if extra else "")
    df = spark.read.schema(schema).csv(path, header=True)
    return df.select(*_stamps(F.col("time")), *[_missing(F.col(c), null_as_zero).alias(c) for c in PRICES], *df.columns[5:])


def _numbered(df: DataFrame, at: Column, null_as_zero: bool, names: tuple[str, ...]) -> DataFrame:
    return df.select(*_stamps(at), *[_missing(F.col(f"`{FIELDS[n]}`"), null_as_zero).alias(n) for n in names], *[c for c in ("code",) if c in df.columns])


def json_nested(spark: SparkSession, path: str, null_as_zero: bool = False) -> DataFrame:
    """One JSON object a line, the time as ISO text in time.$date, numbered fields."""
    schema = T.StructType([T.StructField("time", T.StructType([T.StructField("$date", T.StringType())])), *(T.StructField(f, T.DoubleType()) for f in FIELDS.values())])
    df = spark.read.schema(schema).json(path)
    return _numbered(df, F.try_to_timestamp(F.col("time.`$date`")), null_as_zero, tuple(FIELDS))


def json_dated(spark: SparkSession, path: str, many_lines: bool = False, null_as_zero: bool = False) -> DataFrame:
    """JSON objects with code, an integer trade_date (UTC midnight) and numbered fields; one a line, or an array.

    A field that can't be read is missing and spoils nothing else.
    """
    schema = "code string, trade_date int, " + ", ".join(f"`{f}` double" for f in FIELDS.values())
    df = spark.read.schema(schema).json(path, multiLine=many_lines, mode="PERMISSIVE")
    return _numbered(df, F.try_to_timestamp(F.col("trade_date").cast("string"), F.lit("yyyyMMdd")), null_as_zero, tuple(FIELDS))


def json_text(spark: SparkSession, text: str, **options) -> DataFrame:
    """json_dated for a text held in memory: objects one after another, lines or not, or an array."""
    import json

    at, found, decoder = 0, [], json.JSONDecoder()
    text = text.strip()
    while at < len(text):
        if text[at] in " \t\r\n,[]":
            at += 1
            continue
        one, at = decoder.raw_decode(text, at)
        found += one if isinstance(one, list) else [one]
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    rows = [(None if o.get("code") is None else str(o["code"]), o["trade_date"] if isinstance(o.get("trade_date"), int) else None, *(number(o.get(f)) for f in FIELDS.values())) for o in found]
    df = spark.createDataFrame(rows, "code string, trade_date int, " + ", ".join(f"`{f}` double" for f in FIELDS.values()))
    return _numbered(df, F.try_to_timestamp(F.col("trade_date").cast("string"), F.lit("yyyyMMdd")), options.get("null_as_zero", False), tuple(FIELDS))


def arrays(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """Lists of equal length by name; without time the position orders the bars. Nothing gives an empty table."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ValueError(f"the lists differ in length: { {k: len(v) for k, v in columns.items()} }")
    names = list(columns) if "time" in columns else ["time", *columns]
    data = columns if "time" in columns else {"time": list(range(next(iter(lengths), 0))), **columns}
    rows = [tuple(None if v is None or v != v else float(v) for v in r) for r in zip(*(data[n] for n in names), strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))


def count(bars: DataFrame) -> DataFrame:
    """How many bars there are, as a row."""
    return bars.agg(F.count(F.lit(1)).alias("bars"))


def resample(ticks: DataFrame, value: str, time: str, every: str, symbol: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Bars from single values: first, largest, smallest, last and number of values in each window of `every`."""
    at = F.struct(time, *ties)
    keys = [F.window(time, every).alias("_w"), *([symbol] if symbol else [])]
    out = ticks.groupBy(*keys).agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(value).cast("double").alias("volume"))
    return out.select(*([symbol] if symbol else []), F.col("_w.start").alias("time"), "open", "high", "low", "close", "volume")
