"""Bar-by-bar evaluation of scripts, and Structured Streaming over it.

The state of an instrument is, for every value of the script, as many of its last bars as any call looks back, so it
stays as small as the script's longest length however long the stream runs; where a length is itself a series, or the
first bar is asked for, all bars are kept. Fed one bar at a time the results are
those of the batch, but for islastbar and totalbarscount, which know only the bars so far.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.functions.barwise import RULES, SinceN
from tickloom.functions.registry import REGISTRY, calculates_nothing
from tickloom.plans.compiler import INPUTS
from tickloom.plans.parse import parse
from tickloom.plans.pointwise import POINTWISE
from tickloom.plans.tree import Assign, Back, Binary, Call, Declare, Evaluate, Flag, If, Name, Num, Script, ScriptError, Text, Unary


class Kept:
    """The last values of a series, read by bar number."""

    def __init__(self, size: int | None) -> None:
        self.values, self.end = deque(maxlen=size), 0

    def add(self, v) -> None:
        self.values.append(v)
        self.end += 1

    def __call__(self, j: int):
        k = j - (self.end - len(self.values))
        return self.values[k] if 0 <= k < len(self.values) else None


#: Functions that look no further back than one bar, and where the others have their lengths.
NEAR = set("cross longcross barscount barslast barssince barslastcount barsstatus valuewhen totalbarscount islastbar ema expma ta.ema xma ama dma rsi ta.rsi".split())
LENGTHS = {n: (1,) for n in RULES if n not in NEAR} | {"covar": (2,)} | dict.fromkeys(("last", "findhigh", "findlow", "findhighbars", "findlowbars"), (1, 2))


def lookback(script: Script, least: int = 2, parameters: dict | None = None) -> int | None:
    """Bars that the script's lengths and offsets can reach, added up along nested calls; None: all, as a length is a series."""
    given, unbounded = parameters or {}, False

    def constant(node, env: dict):
        """The number that a node is at every bar, or None."""
        match node:
            case Num(v):
                return v
            case Flag(b):
                return float(b)
            case Name(n):
                return env.get(n)
            case Unary(op, v):
                x = constant(v, env)
                return None if x is None else -x if op == "-" else POINTWISE["not"](x)
            case Binary(op, x, y):
                got = [constant(x, env), constant(y, env)]
                return None if None in got else POINTWISE[op](*got)
            case Call("input.int", args) if args:
                title = args[1].value if len(args) > 1 and isinstance(args[1], Text) else None
                if any(str(k).startswith("input_") for k in given):
                    return None
                x = given.get(title, constant(args[0], env))
                return float(int(x)) if isinstance(x, (int, float)) else None
            case Call(n, args) if n in POINTWISE and args:
                got = [constant(x, env) for x in args]
                return None if None in got else POINTWISE[n](*got)
        return None

    def deep(node, env: dict) -> int:
        nonlocal unbounded
        match node:
            case Call(n, args):
                got = [constant(x, env) for x in args]
                lengths = [got[k] for k in LENGTHS.get(n, ()) if k < len(got)]
                # A start of 0 is the first bar.
                unbounded = unbounded or None in lengths or n == "last" and int(lengths[0]) == 0
                own = sum(int(abs(x)) for x in got if x is not None) * (2 if n == "tma" else 1) if n in RULES else 0
                return own + max([0, *(deep(x, env) for x in args)])
            case Back(base, k):
                n = constant(k, env)
                unbounded = unbounded or n is None
                return int(n or 0) + max(deep(base, env), deep(k, env))
            case Unary(_, v):
                return deep(v, env)
            case Binary(_, x, y):
                return max(deep(x, env), deep(y, env))
        return 0

    def statements(body, env: dict) -> int:
        most = 0
        for s in body:
            match s:
                case Assign(name, v) | Declare(name, v):
                    most = max(most, deep(v, env))
                    env[name] = constant(v, env)
                    if isinstance(v, Call) and v.name == "input.int" and isinstance(given.get(name), (int, float)):
                        env[name] = float(int(given[name]))
                    if isinstance(s, Declare) and s.parameter and name in given:
                        env[name] = given[name] if isinstance(given[name], (int, float)) else None
                case Evaluate(v):
                    most = max(most, deep(v, env))
                case If(t, a, b):
                    x, y = dict(env), dict(env)
                    most = max(most, deep(t, env), statements(a, x), statements(b, y))
                    for n in {**x, **y}:
                        env[n] = x.get(n) if x.get(n) == y.get(n) else None
        return most

    most = statements(script.body, {})
    return None if unbounded else least + most


class Machine:
    """A script's state for one instrument; step() takes a bar and gives the outputs for it."""

    def __init__(self, script: Script | str, language: str = "hithink", parameters: dict | None = None, history: int | None = None) -> None:
        self.script = parse(script, language) if isinstance(script, str) else script
        self.parameters = parameters or {}
        reach = history or lookback(self.script, parameters=self.parameters)
        self.size = history or (None if reach is None else reach + 1)
        self.series: dict[object, Kept] = {}
        self.rules: dict[object, object] = {}
        self.bar = 0

    def step(self, bar: dict) -> dict:
        self.now, self.out, self.calls, self.asked = bar, {}, 0, {}
        self.block(self.script.body, {})
        self.bar += 1
        return self.out

    def snapshot(self) -> bytes:
        """The state as plain values."""
        return pickle.dumps((self.bar, {k: (list(s.values), s.end) for k, s in self.series.items()}, {k: vars(r) for k, r in self.rules.items()}))

    def restored(self, data: bytes) -> Machine:
        """A machine of the same script with a state that snapshot() gave."""
        m = Machine(self.script, parameters=self.parameters, history=self.size)
        m.bar, series, rules = pickle.loads(data)
        for k, (values, end) in series.items():
            m.series[k] = Kept(m.size)
            m.series[k].values.extend(values)
            m.series[k].end = end
        for (k, name), held in rules.items():
            m.rules[k, name] = RULES[name]()
            vars(m.rules[k, name]).update(held)
        return m

    def block(self, body, env: dict) -> None:
        for s in body:
            match s:
                case Assign(name, value, output):
                    env[name] = self.value(value, env, name)
                    if output:
                        self.out[name] = self.number(env[name])
                case Declare(name, value, parameter):
                    env[name] = self.parameters.get(name, self.value(value, env)) if parameter else self.value(value, env)
                case Evaluate(value):
                    self.value(value, env)
                case If(test, then, other):
                    c = self.number(self.value(test, env))
                    a, b = dict(env), dict(env)
                    self.block(then, a), self.block(other, b)  # both, so that their calls keep their histories
                    chosen = a if c is None or c != 0 else b
                    for n in {**a, **b}:
                        env[n] = chosen.get(n)

    @staticmethod
    def number(v):
        if isinstance(v, str):
            raise ScriptError(f"the text {v!r} stands where a number belongs")
        return None if v is None or v != v else v

    def kept(self, key, value) -> Kept:
        s = self.series.setdefault(key, Kept(self.size))
        s.add(value)
        return s

    def value(self, node, env: dict, for_name: str = ""):
        match node:
            case Num(v):
                return v
            case Flag(b):
                return float(b)
            case Text(s):
                return s
            case Name(n):
                if n in env:
                    return env[n]
                known = n.lower() if self.script.language != "pine" else n
                if known in INPUTS:
                    v = self.now.get(INPUTS[known])
                    return None if v is None or v != v else float(v)
                if n.lower().startswith("color"):
                    return n
                raise ScriptError(f"unknown name {n!r}")
            case Unary("-", v):
                x = self.number(self.value(v, env))
                return None if x is None else -x
            case Unary("not", v):
                return POINTWISE["not"](self.number(self.value(v, env)))
            case Binary(op, a, b):
                return POINTWISE[op](self.number(self.value(a, env)), self.number(self.value(b, env)))
            case Back(base, k):
                return self.call("ref", node, [self.value(base, env), self.value(k, env)], [base, k])
            case Call(n, args):
                got = [self.value(a, env) for a in args]
                if n == "indicator":
                    return 0.0
                if n == "input.int":
                    name = for_name or (got[1] if len(got) > 1 else f"input_{len(self.asked) + 1}")
                    self.asked[name] = float(int(self.parameters.get(name, got[0])))
                    return self.asked[name]
                if n.startswith("plot"):
                    title = got[1] if len(got) > 1 and isinstance(got[1], str) and self.script.language == "easylanguage" else n
                    name, k = title, 2
                    while name in self.out:
                        name, k = f"{title}_{k}", k + 1
                    self.out[name] = self.number(got[0])
                    return got[0]
                return self.call(n, node, got, list(args))
        raise ScriptError(f"can't evaluate {node!r}")

    def call(self, name: str, node, got: list, args: list):
        f = REGISTRY.get(name)
        if f is None:
            raise ScriptError(f"unknown function {name!r}")
        if not f.least <= len(got) <= f.most:
            raise ScriptError(f"{name}() takes {f.least} to {f.most} arguments, not {len(got)}")
        got = [self.number(v) for v in got]
        if name == "cost" and not got:
            return self.value(Name("close"), {})
        if name in POINTWISE:
            return POINTWISE[name](*got)
        if name not in RULES:
            if not calculates_nothing(name):
                raise ScriptError(f"{name}() has no rule for single bars; give register() one as `pointwise`")
            return None
        # All calls of a script are made for every bar, always in the same order, which tells them apart.
        site, self.calls = (self.calls, name), self.calls + 1
        reads = [(lambda j, v=a.value: v) if isinstance(a, Num) else self.kept((site, k), v) for k, (a, v) in enumerate(zip(args, got, strict=True))]
        rule = RULES[name]
        if isinstance(rule, type):
            if site not in self.rules:
                self.rules[site] = rule()
                if rule is SinceN:
                    self.rules[site].most = self.size
            rule = self.rules[site]
        own = self.series.setdefault((site, "own"), Kept(self.size))
        own.add(rule(reads, self.bar, own))
        return own(self.bar)


def evaluate(script: str, bars: list[dict], language: str = "hithink", parameters: dict | None = None) -> list[dict]:
    """The outputs for each bar of one instrument, in order; a model to hold plans against."""
    m = Machine(script, language, parameters, history=len(bars) + 2)
    return [m.step(b) for b in bars]


def stream(bars: DataFrame, script: str, outputs: list[str], language: str = "hithink", symbol: str = "symbol", time: str = "time", parameters: dict | None = None, history: int | None = None, late: str = "drop") -> DataFrame:
    """A streaming DataFrame (symbol, time, outputs) for a streaming DataFrame of bars.

    Bars of a batch are put in the order of their time. A bar not after the last one of its instrument is late: it is
    dropped, or with late="null" given back with missing outputs; values already given out are never changed.
    history: bars to keep of each value, by default what the script's lengths reach.
    """
    machine = Machine(script, language, parameters, history)
    fields = [bars.schema[symbol], bars.schema[time], *(T.StructField(o, T.DoubleType()) for o in outputs)]

    def update(key, batches: Iterator[pd.DataFrame], state):
        m, last = (machine.restored(bytes(state.get[0])), pickle.loads(bytes(state.get[1]))) if state.exists else (machine.restored(machine.snapshot()), None)
        got = pd.concat(list(batches)).sort_values(time, kind="stable")
        rows = []
        for r in got.to_dict("records"):
            if last is not None and r[time] <= last:
                if late == "null":
                    rows.append([key[0], r[time], *[None] * len(outputs)])
                continue
            out, last = m.step(r), r[time]
            rows.append([key[0], r[time], *(out.get(o) for o in outputs)])
        state.update((m.snapshot(), pickle.dumps(last)))
        frame = pd.DataFrame(rows, columns=[symbol, time, *outputs])
        yield frame.astype(dict.fromkeys(outputs, "float64"))

    return bars.groupBy(symbol).applyInPandasWithState(update, T.StructType(fields), T.StructType([T.StructField("state", T.BinaryType()), T.StructField("last", T.BinaryType())]), "append", "NoTimeout")
