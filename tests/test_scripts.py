"""Scripts: known values, and plans held against the bar-by-bar model on random bars with gaps."""

import random

import pytest

import tickloom.functions  # noqa: F401
from tickloom.operators.run import run, screen, with_lookback
from tickloom.plans.parse import parse
from tickloom.plans.tree import ScriptError, pretty
from tickloom.sources.bars import arrays
from tickloom.streaming.incremental import Machine, evaluate

P = [10, 11, 12, 13, 14, 15, 16, 17, 16, 15]
# Expression, series, bar, value.
KNOWN = [
    ("ama(c,0.1)", {"close": P}, 9, 12.90678), ("barscount(c)", {"close": [1, 2, 3, 4, 5]}, 4, 5), ("barslast(c > c[1])", {"close": [10, 12, 11, 13, 12]}, 4, 1),
    ("barslastcount(c>10)", {"close": [9, 11, 12, 10, 13, 14]}, 5, 2), ("barssince(c>12)", {"close": [10, 11, 13, 11, 12]}, 4, 2), ("barssincen(c>10,2)", {"close": [9, 11, 9, 12, 13]}, 4, 1),
    ("barsstatus(c>10)", {"close": [9, 11, 12, 10, 13, 14]}, 5, 2), ("const(123.45)", {"close": [1, 2, 3]}, 2, 123.45), ("count(c>10,5)", {"close": [9, 11, 12, 8, 13, 14]}, 5, 4),
    ("dma(c,0.1)", {"close": P}, 9, 12.90678), ("ema(c,3)", {"close": [10, 11, 12, 13]}, 3, 12.125), ("filter(c>10,3)", {"close": [9, 8, 11, 10, 9]}, 4, 0),
    ("hhv(h,3)", {"high": [8, 12, 9, 11]}, 3, 12), ("hhvbars(h,3)", {"high": [8, 12, 9, 11]}, 3, 2), ("hv(h,3)", {"high": [8, 12, 9, 13]}, 3, 12), ("hod(h,2)", {"high": [8, 12, 9, 11]}, 3, 12),
    ("islastbar()", {"close": [1, 2, 3, 4, 5]}, 4, 1), ("islastbar()", {"close": [1, 2, 3, 4, 5]}, 3, 0), ("llv(l,4)", {"low": [8, 12, 5, 11]}, 3, 5), ("llvbars(l,4)", {"low": [8, 12, 5, 11]}, 3, 1),
    ("lv(l,4)", {"low": [8, 12, 5, 1]}, 3, 5), ("lod(l,1)", {"low": [8, 12, 5, 11]}, 3, 5), ("ma(c,3)", {"close": [2, 4, 6, 8]}, 3, 6), ("sma(c,3,1)", {"close": [2, 4, 6, 8]}, 3, 6),
    ("sum(c,3)", {"close": [2, 4, 6, 8]}, 3, 18), ("ref(c,2)", {"close": [10, 20, 30, 40]}, 3, 20), ("totalbarscount()", {"close": [1, 2, 3, 4, 5, 6, 7]}, 6, 7), ("wma(c,3)", {"close": [1, 2, 3, 4]}, 3, 3.333333),
    ("abs(-12.8)/2", {"close": [1]}, 0, 6.4), ("acos(0.5)", {"close": [1]}, 0, 1.047198), ("asin(0.5)", {"close": [1]}, 0, 0.523599), ("atan(1)", {"close": [1]}, 0, 0.785398),
    ("between(c,l,h)", {"low": [9], "high": [11], "close": [10]}, 0, 1), ("between(c,l,h)", {"low": [9], "high": [11], "close": [12]}, 0, 0), ("ceil(3.14)", {"close": [1]}, 0, 4), ("cos(0)", {"close": [1]}, 0, 1),
    ("exp(1)", {"close": [1]}, 0, 2.718282), ("floor(3.99)", {"close": [1]}, 0, 3), ("intpart(3.99)", {"close": [1]}, 0, 3), ("ln(10)", {"close": [1]}, 0, 2.302585), ("log(100)", {"close": [1]}, 0, 2),
    ("max(c,o)", {"close": [10], "open": [12]}, 0, 12), ("min(c,o)", {"close": [10], "open": [12]}, 0, 10), ("mod(10,3)", {"close": [1]}, 0, 1), ("pow(2,10)", {"close": [1]}, 0, 1024),
    ("round(400000/c/100,0)*100", {"close": [4319.43]}, 0, 100), ("sign(-100)", {"close": [1]}, 0, -1), ("sin(0)", {"close": [1]}, 0, 0), ("sqrt(16)-1", {"close": [1]}, 0, 3), ("tan(0)", {"close": [1]}, 0, 0),
    ("if(c>o,1,0)", {"open": [10], "close": [11]}, 0, 1), ("if(c>o,1,0)", {"open": [10], "close": [9]}, 0, 0), ("valuewhen(c>15,o)", {"close": [10, 12, 16, 14], "open": [9, 11, 15, 13]}, 3, 15),
    ("avedev(c,4)", {"close": [2, 4, 4, 4, 5, 8, 8, 8]}, 7, 1.125), ("covar(c,o,4)", {"close": [2, 3, 5, 6], "open": [3, 4, 4, 7]}, 3, 2.666666), ("slope(c,4)", {"close": [10, 11, 12, 13]}, 3, 1),
    ("std(c,4)", {"close": [10, 12, 11, 13]}, 3, 1.290994), ("stddev(c,4)", {"close": [10, 12, 11, 13]}, 3, 1.290994), ("stdp(c,4)", {"close": [10, 12, 11, 13]}, 3, 1.118034),
    ("cross(c,o)", {"open": [10, 10], "close": [9, 11]}, 1, 1), ("cross(c,o)", {"open": [10, 10], "close": [9, 9]}, 1, 0), ("every(c>10,3)", {"close": [9, 12, 11, 13]}, 3, 1), ("exist(c>12,4)", {"close": [9, 11, 10, 13]}, 3, 1),
    ("longcross(c,o)", {"close": [9, 11], "open": [10, 10]}, 1, 1), ("not(c>10)", {"close": [9]}, 0, 1),
]


def test_known_values(spark):
    by_shape: dict = {}
    for k, (expression, series, bar, value) in enumerate(KNOWN):
        by_shape.setdefault(repr(series), (series, []))[1].append((k, expression, bar, value))
    for series, cases in by_shape.values():
        got = {r["time"]: r for r in run(arrays(spark, series), "".join(f"R{k}: {e};" for k, e, _, _ in cases)).collect()}
        for k, e, bar, value in cases:
            assert got[float(bar)][f"R{k}"] == pytest.approx(value, abs=1e-5), e


FRAMED = "ma sum count hhv llv hv lv hhvbars llvbars ref mular wma tma avedev devsq std stdp var varp slope every exist tfilt barssincen filter".split()


@pytest.mark.parametrize("n", [0, 1, 2, 5, 45])
def test_plans_equal_the_model(spark, n):
    rnd = random.Random(n)
    some = lambda p: None if rnd.random() < p else round(rnd.uniform(-3, 3), 1)
    bars = [{"time": float(t), "open": some(0.2), "close": some(0.15), "high": some(0), "low": some(0.5)} for t in range(40)]
    lines = [f"{f}({x},{n})" for f in FRAMED for x in ("C", "H")]
    lines += [f"{f}({x},{n})" for f in ("ema", "expmema", "mema", "xma", "rsi") for x in ("C", "L") if n]
    lines += [f"COVAR(C,O,{n})", f"FINDHIGH(C,{n},3,2)", f"FINDLOWBARS(C,{n},6,2)", f"LAST(C>0,{n},3)", f"LAST(H>-1,0,{n})", f"MA(C,ABS(H)+{n})", f"HHV(C,H+{n})", f"SMA(H,{n},1)", f"H[{n}]"]
    lines += ["CROSS(C,O)", "CROSS(C,0)", "LONGCROSS(H,C)", "BARSLAST(C>1)", "BARSSINCE(C>1)", "VALUEWHEN(C>0,L)", "DMA(C,H/10)", "C>0 AND O>0", "C>0 OR O>0", "H/(C>0)", "ROUND(C*3.3,1)", "MOD(C*10,O)", "ACOS(C)", "LN(C)", "-(C+O)*2", "EMA(MA(C,3)-REF(H,2),4)", "SAR(1,2)", "COST()"]
    script = "\n".join(f"R{k}: {e};" for k, e in enumerate(lines))
    frame = spark.createDataFrame([tuple(b.values()) for b in bars], "time double, open double, close double, high double, low double")
    got, want, trimmed = {r["time"]: r for r in run(frame, script).collect()}, evaluate(script, bars), Machine(script)
    for t, w in enumerate(want):
        small = trimmed.step(bars[t])
        for k, e in enumerate(lines):
            x, y = got[float(t)][f"R{k}"], w[f"R{k}"]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-6, abs=1e-9)), (e, t, x, y)
            if "barssincen" not in e:
                assert small[f"R{k}"] == y, (e, t)


@pytest.mark.parametrize("script", ["A: BARSSINCEN(C>50,3);", "A: BARSSINCEN(C>50,V);", "A: MA(C,10*2);", "N := 4*5; A: MA(C,N);", "A: MA(C,MAX(3,20));", "A: MA(O,V);", "A: O[V];", "A: LAST(O>0,0,1);", "el"])
def test_trimmed_state_reaches_as_far(script):
    rnd = random.Random(8)
    bars = [{"time": float(t), "open": float(t + 1), "close": 60.0 if t % 17 == 3 else rnd.uniform(0, 40), "volume": float(rnd.randint(1, 30))} for t in range(90)]
    kind, given = "hithink", None
    if script == "el":
        script, kind, given = 'Inputs: Length(5); Plot1(Average(Close, Length), "A");', "easylanguage", {"Length": 30}
    m, got = Machine(script, kind, given), []
    for b in bars:
        got.append(m.step(b))
        m = m.restored(m.snapshot())
    assert got == evaluate(script, bars, kind, given) and any(r["A"] is not None for r in got)


def test_front_ends_agree(spark):
    frame = arrays(spark, {"close": [float(x % 7) for x in range(30)], "open": [float(x % 5) for x in range(30)]})
    a = run(frame, "X: EMA(CLOSE,3)+AVERAGE(OPEN,4);").collect()
    b = run(frame, "Inputs: N(3); X = EMA(Close, N) + Average(Open, 4); Plot1(X, \"X\");", "easylanguage").collect()
    c = run(frame, "n = input.int(3)\nx = ema(close, n) + average(open, 4)\nplot(x, color.red)", "pine").collect()
    assert [r[1] for r in a] == [r[1] for r in b] == [r[1] for r in c]
    d = run(frame, "Inputs: N(3); Plot1(EMA(Close, N), \"X\");", "el", parameters={"N": 5}).collect()
    assert [r[1] for r in d] == [r[1] for r in run(frame, "X: EMA(C,5);").collect()]


def test_statements_and_grammar(spark):
    frame = arrays(spark, {"close": [1.0, 5.0, 3.0], "open": [2.0, 2.0, 2.0]})
    pine = "x = 0\nif (close > open) { x = close / 2 } else { x := -open } // comment\nplot(x)\nplot(x + 1)"
    assert [tuple(r)[1:] for r in run(frame, pine, "pine").orderBy("time").collect()] == [(-2.0, -1.0), (2.5, 3.5), (1.5, 2.5)]
    assert run(frame, "{ note } A: C, COLORRED, LINETHICK1; // more\nSELECT C>O").columns == ["time", "A", "select"]
    assert [r["time"] for r in screen(run(frame, "SELECT C>O")).orderBy("time").collect()] == [1.0, 2.0]
    assert [r["B"] for r in run(frame, "A := C*2; B: (A - 1) * -A[1] + (2 <> 3)").orderBy("time").collect()] == [None, -17.0, -49.0]
    again = pretty(parse("A: -(C+O)*2 - (1-2); B := REF(A,1)[2] = 3 OR NOT(1);", "tdx"))
    assert pretty(parse(again)) == again


@pytest.mark.parametrize(("script", "what"), [("A: NOPE(C)", "unknown function"), ("A: MA(C)", "takes 2 arguments"), ("A: X", "unknown name"), ("C: 1", "input"), ("A: 'x'+1", "text"), ("A: (C", "expected"), ("A: C C", "end of the statement"), ("A: V", "no input"), ("A: C $ 1", "unexpected")])
def test_errors_come_before_anything_runs(spark, script, what):
    with pytest.raises(ScriptError, match=what):
        run(arrays(spark, {"close": [1.0]}), script)


def test_instruments_are_apart_and_ties_ordered(spark):
    rows = [("a", 1, 1, 10.0), ("b", 1, 1, 1.0), ("a", 1, 2, 20.0), ("b", 2, 1, 3.0), ("a", 2, 1, float("nan")), ("a", 3, 1, 7.0)]
    frame = spark.createDataFrame(rows, "symbol string, time int, tie int, close double")
    got = {(r["symbol"], r["time"], r["tie"]): (r["A"], r["B"]) for r in run(frame, "A: REF(C,1); B: EMA(C,3);", symbol="symbol", ties=("tie",)).collect()}
    assert got == {("a", 1, 1): (None, 10.0), ("a", 1, 2): (10.0, 15.0), ("a", 2, 1): (20.0, None), ("a", 3, 1): (None, 7.0), ("b", 1, 1): (None, 1.0), ("b", 2, 1): (1.0, 2.0)}
    near = with_lookback(frame, 2, 3, "A: REF(C,1);", 1, symbol="symbol", ties=("tie",)).where("symbol = 'a'").orderBy("time").collect()
    assert [r["A"] for r in near] == [20.0, None]
    assert run(frame.where("false"), "A: EMA(MA(C,2),3);", symbol="symbol").count() == 0


def test_one_exchange_for_all_windows(spark):
    frame = arrays(spark, {"close": [1.0, 2.0]}).selectExpr("*", "1 as symbol")
    plan = run(frame, "M5: MA(C,5); M10: MA(C,10); S: CROSS(M5,M10); T: HHV(M5,3); N: REF(T,1);", symbol="symbol")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_weighted_sma(spark):
    got = run(arrays(spark, {"close": [3.0, 6.0, 9.0]}), "A: SMA(C,3,1);", weighted_sma=True).orderBy("time").collect()
    assert [r["A"] for r in got] == pytest.approx([3.0, 4.0, 4.0 + 5 / 3])


def test_streams_take_parameters_and_functions_of_users(spark):
    from tickloom.functions.registry import REGISTRY, register
    from tickloom.plans.pointwise import POINTWISE
    from tickloom.streaming.incremental import Machine

    close = [float(k * 7 % 11) for k in range(60)]
    frame = arrays(spark, {"close": close})
    cases = [("n = input.int(3, \"N\")\nplot(ta.sma(close, n))", "pine", {"n": 20}), ("Inputs: N(3); Plot1(Average(Close, N), \"M\");", "easylanguage", {"N": 30}), ("plot(ta.sma(close, input.int(2, \"N\")))", "pine", {"N": 9}), ("N:=4*5; A: MA(C,N); B: BARSSINCEN(C>5,3); D: HHV(C,BARSLAST(C>8)+1);", "hithink", {})]
    for script, language, parameters in cases:
        want = [r.asDict() for r in run(frame, script, language, parameters=parameters).orderBy("time").collect()]
        m = Machine(script, language, parameters)
        for bar, row in zip([{"close": c} for c in close], want, strict=True):
            for name, v in m.step(bar).items():
                assert v == pytest.approx(row[name]), (script, row)
    try:
        register("twice", args=1, pointwise=lambda x: None if x is None else 2 * x)(lambda x: x * 2)
        register("thrice", args=1)(lambda x: x * 3)
        assert [r["A"] for r in run(frame, "A: TWICE(C);").orderBy("time").collect()] == [Machine("A: TWICE(C);").step({"close": c})["A"] for c in close]
        with pytest.raises(ScriptError, match="no rule"):
            Machine("A: THRICE(C);").step({"close": 1.0})
        assert Machine("A: WINNER(C);").step({"close": 1.0}) == {"A": None}
    finally:
        for name in ("twice", "thrice"):
            REGISTRY.pop(name, None)
            POINTWISE.pop(name, None)
