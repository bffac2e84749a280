"""Queries of every function over bars made of the `events` table, with SQL that gives the same results.

Bars: one instrument a user, ordered by ts and event_id; close is the value, missing for every 17th event; open, high,
low and volume follow from it and the event's number. Results are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tickloom.functions  # noqa: F401
from tickloom.operators.run import run, screen
from tickloom.sources.bars import count, mock, resample

BARS = """
select user_id, event_id, ts, close, open, greatest(coalesce(close, open), open) + event_id % 3 as high,
       least(coalesce(close, open), open) - event_id % 5 as low, cast(event_id % 50 as double) as volume
from (select user_id, event_id, ts, case when event_id % 17 = 0 then null else value end as close,
             cast((event_id * 7) % 100 as double) as open from events)"""
#: The same for SQL, with the number of the bar.
BASE = f"b as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from ({BARS}))"
KEYS = ("user_id", "event_id")
ORDER = "partition by user_id order by ts, event_id"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value")
    e = e.select("user_id", "event_id", "ts", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("close"), ((F.col("event_id") * 7) % 100).cast("double").alias("open"))
    known = F.coalesce("close", "open")
    return e.withColumns({"high": F.greatest(known, F.col("open")) + F.col("event_id") % 3, "low": F.least(known, F.col("open")) - F.col("event_id") % 5, "volume": (F.col("event_id") % 50).cast("double")})


def scripted(script: str, language: str = "hithink", **options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(bars(spark, sf_dir), script, language, symbol="user_id", time="ts", ties=("event_id",), **options)
        return out.select(*KEYS, *[F.round(c, 6).alias(c) for c in out.columns if c not in ("user_id", "event_id", "ts")])

    return query


# -- SQL pieces

def over(n: int, end: int = 0) -> str:
    return f"over ({ORDER} rows between {n - 1 + end} preceding and {f'{end} preceding' if end else 'current row'})"


CUM = f"over ({ORDER} rows between unbounded preceding and current row)"
LAG = f"over ({ORDER})"


def full(what: str, x: str, n: int) -> str:
    return f"case when count({x}) {over(n)} = {n} then {what} {over(n)} end"


def sql(*levels: dict[str, str], final: dict[str, str]) -> str:
    """Each level adds columns to the one before; the last gives the results."""
    parts, of = [BASE], "b"
    for k, level in enumerate(levels):
        parts.append(f"l{k} as (select *, {', '.join(f'{e} as {n}' for n, e in level.items())} from {of})")
        of = f"l{k}"
    return f"with {', '.join(parts)} select {', '.join(KEYS)}, {', '.join(f'round(cast({e} as double), 6) as {n}' for n, e in final.items())} from {of}"


def folded(start: dict[str, str], step: dict[str, str], final: dict[str, str], before: str = "") -> str:
    """A recursion from bar to bar: start and step give the columns that are carried, with r the bar before."""
    return (
        f"with recursive {BASE}{before}, s as (select * from {'x' if before else 'b'}), "
        f"r as (select user_id, event_id, i, {', '.join(f'cast({e} as double) as {n}' for n, e in start.items())} from s where i = 0 "
        f"union all select s.user_id, s.event_id, s.i, {', '.join(f'cast({step[n]} as double)' for n in start)} from r join s on s.user_id = r.user_id and s.i = r.i + 1) "
        f"select user_id, event_id, {', '.join(f'round({e}, 6) as {n}' for n, e in final.items())} from r"
    )


TRUE = "(coalesce(close > 50, false))"
LAST_TRUE = f"last_value(case when {TRUE} then i end ignore nulls) {CUM}"
LAST_FALSE = f"last_value(case when not {TRUE} then i end ignore nulls) {CUM}"


def extreme_bars(kind: str, x: str, n: int) -> str:
    return f"coalesce(i - {kind}(i, case when {x} is not null then row({'-' if kind == 'arg_min' else ''}{x}, {'i' if kind == 'arg_min' else '-i'}) end) {over(n)}, -1)"


def nth(x: str, n: int, m: int, t: int, descending: bool) -> str:
    return f"list_sort(list({x}) filter ({x} is not null) {over(m, n)}, '{'DESC' if descending else 'ASC'}')[{t}]"


def nth_bars(x: str, n: int, m: int, t: int, sign: str) -> str:
    """Bars since the t-th of the m bars before the last n by value, the oldest of equal ones first."""
    return f"i - struct_extract(list_sort(list(struct_pack(v := {sign}{x}, at := i)) filter ({x} is not null) {over(m, n)})[{t}], 'at')"


def crossing(a: str, b: str, pa: str, pb: str, both: bool = True) -> str:
    up = f"({a} > {b} and {pa} <= {pb})"
    return f"case when coalesce({up}{f' or ({a} < {b} and {pa} >= {pb})' if both else ''}, false) then 1 else 0 end"


SPECS: dict[str, tuple[str, str | None]] = {
    "ma": ("M: MA(C,5); A: AVERAGE(O,3); S: SMA(C,4,1);", sql(final={"M": full("avg(close)", "close", 5), "A": full("avg(open)", "open", 3), "S": full("avg(close)", "close", 4)})),
    "sum": ("A: SUM(C,5); B: SUMBARS(V,3);", sql(final={"A": full("sum(close)", "close", 5), "B": full("sum(volume)", "volume", 3)})),
    "deviation": ("A: STD(C,5); B: STDDEV(O,4); P: STDP(C,5); D: VAR(C,6); E: VARP(O,6);", sql(final={"A": full("stddev_samp(close)", "close", 5), "B": full("stddev_samp(open)", "open", 4), "P": full("stddev_pop(close)", "close", 5), "D": full("var_samp(close)", "close", 6), "E": full("var_pop(open)", "open", 6)})),
    "covar": ("A: COVAR(C,O,5);", sql(final={"A": full("covar_samp(close, open)", "close", 5)})),
    "slope": ("A: SLOPE(C,5);", sql(final={"A": full("regr_slope(close, i)", "close", 5)})),
    "mular": ("A: MULAR(C/50,3);", sql({"x": "close / 50"}, final={"A": full("product(x)", "x", 3)})),
    "wma": ("A: WMA(C,3);", sql(final={"A": f"(3 * close + 2 * lag(close, 1) {LAG} + lag(close, 2) {LAG}) / 6"})),
    "tma": ("A: TMA(C,3);", sql({"m": full("avg(close)", "close", 3)}, final={"A": full("avg(m)", "m", 3)})),
    "extremes": ("A: HHV(C,5); B: LLV(C,5); D: HV(C,4); E: LV(C,4);", sql(final={"A": f"max(close) {over(5)}", "B": f"min(close) {over(5)}", "D": f"max(close) {over(4, 1)}", "E": f"min(close) {over(4, 1)}"})),
    "extreme_bars": ("A: HHVBARS(C,6); B: LLVBARS(C,6);", sql(final={"A": extreme_bars("arg_min", "close", 6), "B": extreme_bars("arg_max", "-close", 6)})),
    "count": ("A: COUNT(C>50,5); B: EXIST(C>80,4); D: TFILTER(C>80,3);", sql(final={"A": f"count(*) filter (close > 50) {over(5)}", "B": f"case when count(*) filter (close > 80) {over(4)} > 0 then 1 else 0 end", "D": f"case when count(*) filter (close > 80) {over(3)} > 0 then 1 else 0 end"})),
    "every": ("A: EVERY(C>20,3); B: TFILT(C>20,3);", sql(final={"A": f"case when i >= 2 and count(*) filter (close > 20) {over(3)} = 3 then 1 else 0 end", "B": f"case when count(*) filter (close > 20) {over(3)} = count(*) {over(3)} then 1 else 0 end"})),
    "avedev": ("A: AVEDEV(C,4);", sql({"l": f"list(close) filter (close is not null) {over(4)}"}, final={"A": "list_avg(list_transform(l, lambda x: abs(x - list_avg(l))))"})),
    "devsq": ("A: DEVSQ(C,4);", sql(final={"A": f"var_pop(close) {over(4)} * count(close) {over(4)}"})),
    "ta_sma": ("x = ta.sma(close, 4)\nplot(x)", sql(final={"plot": f"case when i >= 3 then avg(close) {over(4)} end"})),
    "find": ("A: FINDHIGH(C,1,5,2); B: FINDLOW(C,2,4,1);", sql(final={"A": nth("close", 1, 5, 2, True), "B": nth("close", 2, 4, 1, False)})),
    "find_bars": ("A: FINDHIGHBARS(O,0,5,1); B: FINDLOWBARS(O,0,5,1);", sql(final={"A": extreme_bars("arg_min", "open", 5), "B": extreme_bars("arg_max", "-open", 5)})),
    "ref": ("A: REF(C,2); B: C[1]; D: HOD(H,1); E: LOD(L,3); G: REFV(C,4); K: LOWRANGE(L,1); F: REF(C,-1);", sql(final={"A": f"lag(close, 2) {LAG}", "B": f"lag(close, 1) {LAG}", "D": f"lag(high, 1) {LAG}", "E": f"lag(low, 3) {LAG}", "G": f"lag(close, 4) {LAG}", "K": f"lag(low, 1) {LAG}", "F": f"lead(close, 1) {LAG}"})),
    "cross": ("A: CROSS(C,O); B: LONGCROSS(C,O); D: CROSS(C,50);", sql({"pc": f"lag(close) {LAG}", "po": f"lag(open) {LAG}"}, final={"A": crossing("close", "open", "pc", "po"), "B": crossing("close", "open", "pc", "po", False), "D": crossing("close", "50", "pc", "50")})),
    "last": ("A: LAST(C>20,1,3); B: LAST(C>20,3,1); D: LAST(C>20,0,2);", sql(final={"A": f"case when count(*) filter (close > 20) {over(3, 1)} = 3 then 1 else 0 end", "B": "1", "D": f"case when i > 2 then 1 when i = 2 and coalesce(first_value(close) {CUM} > 20, false) then 1 else 0 end"})),
    "barscount": ("A: BARSCOUNT(C); B: TOTALBARSCOUNT(); D: ISLASTBAR();", sql(final={"A": f"count(close) {CUM}", "B": "count(*) over (partition by user_id)", "D": "case when i = max(i) over (partition by user_id) then 1 else 0 end"})),
    "barslast": ("A: BARSLAST(C>50); B: BARSSINCE(C>50); D: BARSLASTCOUNT(C>50); E: BARSSTATUS(C>50);", sql(final={"A": f"i - {LAST_TRUE}", "B": f"coalesce(i - {LAST_TRUE}, -1)", "D": f"i - coalesce({LAST_FALSE}, -1)", "E": f"i - coalesce({LAST_FALSE}, -1)"})),
    "barssincen": ("A: BARSSINCEN(C>50,3);", sql({"l": f"list(i) filter ({TRUE}) {CUM}"}, final={"A": "coalesce(i - l[greatest(len(l) - 2, 1)], -1)"})),
    "valuewhen": ("A: VALUEWHEN(C>50,O);", sql({"j": f"last_value(case when coalesce(close > 50, true) then i end ignore nulls) {CUM}"}, final={"A": "case when j is not null then (list(open) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row))[j + 1] end"})),
    "ema": ("A: EMA(C,5); B: EXPMA(O,4);", folded({"A": "close", "B": "open"}, {"A": "case when s.close is null then null when r.A is null then s.close else (2 * s.close + 4 * r.A) / 6 end", "B": "(2 * s.open + 3 * r.B) / 5"}, {"A": "A", "B": "B"})),
    "ta_ema": ("plot(ta.ema(open, 4))", folded({"e": "open"}, {"e": "r.e + 2.0 / 5 * (s.open - r.e)"}, {"plot": "e"})),
    "expmema": ("A: EXPMEMA(C,6); B: MEMA(C,7);", folded({"A": "null", "B": "null"}, {"A": "case when s.i < 5 or s.close is null then null when r.A is null then s.m else (2 * s.close + 5 * r.A) / 7 end", "B": "case when s.close is null then null when r.B is null then s.m7 else (s.close + 6 * r.B) / 7 end"}, {"A": "A", "B": "B"}, f", x as (select *, {full('avg(close)', 'close', 6)} as m, {full('avg(close)', 'close', 7)} as m7 from b)")),
    "xma": ("A: XMA(C,7);", folded({"A": "close"}, {"A": "case when s.close is null then null when r.A is null then s.close else (s.close + 6 * r.A) / 7 end"}, {"A": "A"})),
    "ama_dma": ("A: AMA(C,0.2); B: DMA(C,V/50);", folded({"A": "close", "B": "close"}, {"A": "case when s.close is null then null when r.A is null then s.close else r.A + 0.2 * (s.close - r.A) end", "B": "case when s.close is null then null when r.B is null then s.close else r.B + s.volume / 50 * (s.close - r.B) end"}, {"A": "A", "B": "B"})),
    "filter": ("A: FILTER(O>60,3);", folded({"A": "case when open > 60 then 1 else 0 end", "k": "case when open > 60 then 0 else 99 end"}, {"A": "case when r.k + 1 < 3 then 0 when s.open > 60 then 1 else 0 end", "k": "case when r.k + 1 >= 3 and s.open > 60 then 0 else r.k + 1 end"}, {"A": "A"})),
    "rsi": ("A: RSI(O,5);", folded({"n": "0", "g": "0", "d": "0", "p": "open"}, {"n": "r.n + 1", "g": "r.g + (greatest(s.open - r.p, 0) - r.g) / least(r.n + 1, 5)", "d": "r.d + (greatest(r.p - s.open, 0) - r.d) / least(r.n + 1, 5)", "p": "s.open"}, {"A": "case when n >= 5 then 100 - 100 / (1 + g / case when d = 0 then 1e-10 else d end) end"})),
    "macd": ("DIF: EMA(O,6) - EMA(O,13); DEA: EMA(DIF,4); MACD: 2*(DIF-DEA);", folded({"a": "open", "c": "open", "d": "0"}, {"a": "(2 * s.open + 5 * r.a) / 7", "c": "(2 * s.open + 12 * r.c) / 14", "d": "(2 * ((2 * s.open + 5 * r.a) / 7 - (2 * s.open + 12 * r.c) / 14) + 3 * r.d) / 5"}, {"DIF": "a - c", "DEA": "d", "MACD": "2 * (a - c - d)"})),
    "kdj": ("RSV:=(O-LLV(L,9))/(HHV(H,9)-LLV(L,9))*100; K: SMA(RSV,3,1); D: SMA(K,3,1); J: 3*K-2*D;", sql({"lo": f"min(low) {over(9)}", "hi": f"max(high) {over(9)}"}, {"v": "(open - lo) / nullif(hi - lo, 0) * 100"}, {"k": full("avg(v)", "v", 3)}, {"d": full("avg(k)", "k", 3)}, final={"K": "k", "D": "d", "J": "3 * k - 2 * d"})),
    "arithmetic": ("A: (C+O)*2-V; B: C/(V-10)*0.70710678; D: -(C-O); E: -O[1]; F: 2+3*4;", sql(final={"A": "(close + open) * 2 - volume", "B": "close / nullif(volume - 10, 0) * 0.70710678", "D": "-(close - open)", "E": f"-lag(open) {LAG}", "F": "14"})),
    "comparison": ("A: C>O; B: C>=50; D: C<O; E: C<=50; G: V=10; K: V<>10;", sql(final={"A": "cast(close > open as int)", "B": "cast(close >= 50 as int)", "D": "cast(close < open as int)", "E": "cast(close <= 50 as int)", "G": "cast(volume = 10 as int)", "K": "cast(volume <> 10 as int)"})),
    "logic": ("A: C>50 AND O>50; B: C>50 OR O>50; D: NOT(C>50); E: ISNULL(C); G: IF(C>50,O,V);", sql(final={"A": "case when close is not null then cast(close > 50 and open > 50 as int) end", "B": "case when close is not null then cast(close > 50 or open > 50 as int) end", "D": "cast(close <= 50 as int)", "E": "cast(close is null as int)", "G": "case when coalesce(close > 50, true) then open else volume end"})),
    "rounding": ("A: CEIL(C); B: CEILING(O/3); D: FLOOR(C); E: INTPART(C-50); G: FACEPART(C-50); K: ROUND(C,1); N: ROUND2(C/3,2); P: SIGN(C-50);", sql(final={"A": "ceil(close)", "B": "ceil(open / 3)", "D": "floor(close)", "E": "trunc(close - 50)", "G": "trunc(close - 50)", "K": "sign(close) * floor(abs(close * 10) + 0.5) / 10", "N": "sign(close) * floor(abs(close / 3 * 100) + 0.5) / 100", "P": "sign(close - 50)"})),
    "trigonometry": ("A: SIN(C); B: COS(C); D: TAN(V/50); E: ATAN(C); G: ASIN(V/25); K: ACOS(V/25);", sql(final={"A": "sin(close)", "B": "cos(close)", "D": "tan(volume / 50)", "E": "atan(close)", "G": "case when volume <= 25 then asin(least(volume / 25, 1)) end", "K": "case when volume <= 25 then acos(least(volume / 25, 1)) end"})),
    "powers": ("A: EXP(V/10); B: LN(V); D: LOG(V); E: SQRT(C-50); G: POW(V,2); K: ABS(C-50); N: MOD(O,7);", sql(final={"A": "exp(volume / 10)", "B": "case when volume > 0 then ln(volume) end", "D": "case when volume > 0 then log10(volume) end", "E": "case when close >= 50 then sqrt(close - 50) end", "G": "volume * volume", "K": "abs(close - 50)", "N": "cast(open as bigint) % 7"})),
    "ranges": ("A: MAX(C,O); B: MIN(C,O); D: BETWEEN(C,L,H); E: RANGE(C,L,H); G: CONST(C); K: REVERSE(C); N: COST(O);", sql(final={"A": "case when close is not null then greatest(close, open) end", "B": "case when close is not null then least(close, open) end", "D": "cast(close between low and high as int)", "E": "cast(coalesce(close > low and close < high, false) as int)", "G": "close", "K": "close", "N": "open"})),
    "dynamic_length": ("A: MA(O,MOD(V,4)+1);", sql({"n": "volume % 4 + 1", "l": f"list(open) {CUM}"}, final={"A": "case when len(l) >= n then list_avg(l[len(l) - cast(n as int) + 1:]) end"})),
    "branches": ("If Close > Open Then Begin X = Close; End Else X = Open - 1; Plot1(X, \"X\");", sql(final={"X": "case when coalesce(close > open, true) then close else open - 1 end"})),
    "pine_branches": ("if (open > 50) { x = open * 2 } else { x = 0 - open }\nplot(x / 4)", sql(final={"plot": "case when open > 50 then open * 2 else -open end / 4"})),
    "easylanguage": ("Inputs: Length(5); Variables: M(0); M = Average(Close, Length); Plot1(M, \"M\");", sql(final={"M": full("avg(close)", "close", 5)})),
    "two_averages": ("MA5: MA(CLOSE,5);\nMA10: MA(CLOSE,10);\nSIG: CROSS(MA5,MA10);", sql({"MA5": full("avg(close)", "close", 5), "MA10": full("avg(close)", "close", 10)}, {"p5": f"lag(MA5) {LAG}", "p10": f"lag(MA10) {LAG}"}, final={"MA5": "MA5", "MA10": "MA10", "SIG": crossing("MA5", "MA10", "p5", "p10")})),
    "stubs": ("A: SAR(1,2); B: WINNER(C); D: BETA(C,O); E: CURRBARSCOUNT(); G: REFDATE(C,1); K: COSTEX(C); N: LFS(); P: IFF(C,1,2); Q: TESTSKIP(1); R: UPNDAY(C,2); S: FORCAST(C,3); T: RELATE(C,O,3); U: BETAX(C,O,3); W: TOTALRANGE();", sql(final=dict.fromkeys("ABDEGKNPQRSTUW", "null"))),
    "more_stubs": ("A: LWINNER(); B: NEWSAR(); D: PPART(); E: PWINNER(C); G: SARTURN(); K: IFC(C,1,2); N: IFN(C,1,2); P: DOWNNDAY(C,2); Q: NDAY(C,O);", sql(final=dict.fromkeys("ABDEGKNPQ", "null"))),
    "pine_inputs": ("indicator(\"mean\")\nn = input.int(3, \"N\")\nplot(ta.sma(close, n))", sql(final={"plot": f"case when i >= 3 then avg(close) {over(4)} end"})),
    "plots": ("Plot1(Close, \"A\"); Plot2(Open + 1, \"B\"); Plot3(High, \"D\"); Plot4(Low * 2, \"E\"); Plot5(Volume, \"G\");", sql(final={"A": "close", "B": "open + 1", "D": "high", "E": "low * 2", "G": "volume"})),
    "find_bars_ranked": ("A: FINDHIGHBARS(O,1,5,2); B: FINDLOWBARS(C,2,6,3);", sql(final={"A": nth_bars("open", 1, 5, 2, "-"), "B": nth_bars("close", 2, 6, 3, "")})),
    "rand": ("A: RAND();", None),
}
SPECS["ta_rsi"] = ("plot(ta.rsi(open, 5))", SPECS["rsi"][1].replace(" as A from r", " as plot from r"))
#: Parameters that queries are given.
OPTIONS: dict[str, dict] = {"pine_inputs": {"parameters": {"n": 4}}}
LANGUAGES = {"pine_inputs": "pine", "ta_rsi": "pine", "plots": "easylanguage", "ta_sma": "pine", "ta_ema": "pine", "pine_branches": "pine", "branches": "easylanguage", "easylanguage": "easylanguage"}


def high_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose close is the highest of 52 and above the mean of 20, by the selected flag."""
    out = run(bars(spark, sf_dir), "M: MA(O,20); SELECT O>=HHV(O,52) AND O>M;", symbol="user_id", time="ts", ties=("event_id",))
    return screen(out).select(*KEYS, F.round("M", 6).alias("M"), F.col("select").alias("flag"))


HIGH_SCREEN = f"""with {BASE}, l as (select *, {full('avg(open)', 'open', 20)} as M, max(open) {over(52)} as hi from b)
select user_id, event_id, round(M, 6) as M, 1.0::double as flag from l where open >= hi and open > M"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 6 hours from single values, with their mean of 3."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = run(resample(e, "value", "ts", "6 hours", ties=("event_id",)), "M: MA(C,3); R: H-L; F: O; N: V;", time="time")
    return out.select("time", *[F.round(c, 6).alias(c) for c in "MRFN"])


HOURLY = """with g as (select time_bucket(interval '6 hours', ts) as time, arg_min(value, (ts, event_id)) as o, max(value) as h, min(value) as l,
arg_max(value, (ts, event_id)) as c, count(value) as v from events group by 1)
select time, round(case when count(c) over w = 3 then avg(c) over w end, 6) as M, round(h - l, 6) as R, round(o, 6) as F, v::double as N
from g window w as (order by time rows between 2 preceding and current row)"""

def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated bars."""
    return mock(spark, 1000).select(*[F.round(c, 6).alias(c) for c in ("time", "open", "high", "low", "close", "volume")])


GENERATED = """with k as (select range as k from range(1000)), c as (select k, 100 + 0.5 * (k % 20 - 10) as close from k),
o as (select *, close - 0.1 * (k % 5 - 2) as open from c)
select cast(1672531200 + 60 * k as double) as time, round(cast(open as double), 6) as open, round(cast(greatest(open, close) + 0.05 * (k % 3) as double), 6) as high,
round(cast(least(open, close) - 0.05 * (k % 3) as double), 6) as low, round(cast(close as double), 6) as close, cast(1000 + 100 * (k % 5) as double) as volume from o"""


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bars there are."""
    return count(bars(spark, sf_dir))


ROW_COUNT = "select count(*) as bars from events"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: scripted(s, LANGUAGES.get(n, "hithink"), **OPTIONS.get(n, {})) for n, (s, _) in SPECS.items()} | {"high_screen": high_screen, "resampled": hourly, "generated": generated, "row_count": row_count}
ORACLES: dict[str, str] = {n: o for n, (_, o) in SPECS.items() if o} | {"high_screen": HIGH_SCREEN, "resampled": HOURLY, "generated": GENERATED, "row_count": ROW_COUNT}
