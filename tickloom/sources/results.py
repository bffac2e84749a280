"""Writing and showing what a script gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _time(df: DataFrame, time: str) -> Column:
    kind = dict(df.dtypes)[time]
    if kind.startswith("timestamp") or kind == "date":
        return F.date_format(time, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.col(time) > 0, F.from_unixtime(F.col(time).cast("long"), "yyyy-MM-dd HH:mm:ss"))


def formatted(df: DataFrame, time: str = "time", precision: int = 3) -> DataFrame:
    """Times as text (blank if missing or not after 1970), numbers with `precision` decimals, missing ones as nan."""
    number = lambda c: F.coalesce(F.format_string(f"%.{precision}f", F.col(c)), F.lit("nan"))
    out = [_time(df, time).alias(time) if c == time else F.when(F.col(c).isNull(), F.lit("nan")).otherwise(number(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*out)


def write_csv(df: DataFrame, path: str, time: str = "time", precision: int = 3, ordered: bool = True) -> None:
    """CSV files with a header; ordered by time over all files."""
    out = df.orderBy(time) if ordered else df
    formatted(out, time, precision).write.mode("overwrite").option("emptyValue", "").csv(path, header=True, nullValue="")


def csv_text(df: DataFrame, time: str = "time", precision: int = 3) -> str:
    """The CSV as one text; for results that fit the driver."""
    out = formatted(df.orderBy(time), time, precision)
    lines = [",".join("" if v is None else str(v) for v in r) for r in out.collect()]
    return "\n".join([",".join(out.columns), *lines]) + "\n"


def ends(df: DataFrame, time: str = "time", n: int = 10) -> DataFrame:
    """The first and the last n rows by time, with `edge` saying which."""
    first = df.orderBy(time).limit(n).withColumn("edge", F.lit("first"))
    return first.unionByName(df.orderBy(F.col(time).desc()).limit(n).withColumn("edge", F.lit("last")))


def latest(df: DataFrame, columns: list[str], time: str = "time", symbol: str | None = None) -> DataFrame:
    """The values of the last bar, of each instrument if there are several."""
    picks = [F.max_by(c, time).alias(c) for c in columns]
    return df.groupBy(symbol).agg(F.max(time).alias(time), *picks) if symbol else df.agg(F.max(time).alias(time), *picks)
