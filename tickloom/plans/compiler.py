"""From a script's tree to stages of columns.

Every window call becomes a column of the earliest stage whose inputs exist, equal calls become one, and all windows
of all stages share one order, so a script costs one exchange and one sort. Calls that need their own earlier values,
or whose lengths are series, become folds: one pass over an instrument's bars for all those of a stage. A stage is one
select; scalar expressions are put where they are used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.registry import REGISTRY, Frames, missing, number, unless_zero
from tickloom.plans.tree import Assign, Back, Binary, Call, Declare, Evaluate, Flag, If, Name, Num, Script, ScriptError, Text, Unary

#: The inputs of a script and their other names, in any case.
INPUTS = {"c": "close", "close": "close", "o": "open", "open": "open", "h": "high", "high": "high", "l": "low", "low": "low", "v": "volume", "vol": "volume", "volume": "volume", "amount": "amount", "date": "date", "time": "time"}
#: Variables with longer expressions become columns, so that plans stay small.
LONGEST_KEY = 300


@dataclass(frozen=True)
class Term:
    """A value: its column, the stage before which it can be evaluated, a name that equal values share, and a constant if it is one."""

    column: Column | None
    level: int
    key: str
    constant: object = None
    refs: frozenset = frozenset()


@dataclass
class Fold:
    """One recursive call: the rule's name, columns or constants of its arguments, and the column it makes."""

    rule: str
    args: list
    out: str


@dataclass
class Stage:
    columns: dict[str, Column] = field(default_factory=dict)
    folds: list[Fold] = field(default_factory=list)


@dataclass
class Output:
    name: str
    term: Term
    style: tuple[str, ...] = ()


@dataclass
class Plan:
    stages: list[Stage]
    outputs: list[Output]
    inputs: list[str]
    title: dict
    parameters: dict[str, float]
    needs_index: bool


def constant(value) -> Term:
    if isinstance(value, str):
        return Term(None, 0, f"'{value}'", value)
    return Term(F.lit(float(value)), 0, repr(float(value)), float(value))


class Compiler:
    def __init__(self, script: Script, available: list[str], frames: Frames, parameters: dict | None = None, weighted_sma: bool = False) -> None:
        self.script, self.frames, self.parameters = script, frames, dict(parameters or {})
        self.available = {a for a in available}
        self.stages: list[Stage] = []
        self.made: dict[str, Term] = {}
        self.outputs: dict[str, Output] = {}
        self.plots: list[Output] = []
        self.inputs: dict[str, None] = {}
        self.title: dict = {}
        self.given: dict[str, float] = {}
        self.indexed = False
        self.weighted_sma = weighted_sma

    def compile(self) -> Plan:
        env = self.block(self.script.body, {})
        for o in self.outputs.values():
            if o.name in env:  # a later assignment of the same name is the value that counts
                o.term = env[o.name]
        return Plan(self.stages, [*self.outputs.values(), *self.plots], list(self.inputs), self.title, self.given, self.indexed)

    # -- statements

    def block(self, body, env: dict[str, Term]) -> dict[str, Term]:
        for s in body:
            match s:
                case Assign(name, value, output, style):
                    if name.lower() in INPUTS and name.lower() != "select":
                        raise ScriptError(f"{name!r} is an input and can't be assigned")
                    term = self.named(self.value(value, env, name))
                    if isinstance(term.constant, str):
                        raise ScriptError(f"{name!r} can't hold a text")
                    env = env | {name: term}
                    if output:
                        self.outputs[name] = Output(name, term, style)
                case Declare(name, value, parameter):
                    term = self.value(value, env)
                    if parameter:
                        if name in self.parameters:
                            term = constant(self.parameters[name])
                        self.given[name] = term.constant
                    env = env | {name: term}
                case Evaluate(value):
                    self.value(value, env)
                case If(test, then, other):
                    t = self.numeric(self.value(test, env))
                    a, b = self.block(then, env), self.block(other, env)
                    for name in {**a, **b}:
                        x, y = a.get(name), b.get(name)
                        if x is not y:
                            env = env | {name: self.named(self.branch(t, x, y))}
        return env

    def branch(self, test: Term, a: Term | None, b: Term | None) -> Term:
        a, b = (x or Term(missing(), 0, "missing") for x in (a, b))
        return self.scalar("if", [test, a, b], lambda t, x, y: F.when(unless_zero(t), x).otherwise(y))

    def named(self, term: Term) -> Term:
        """Long expressions that a variable stands for become columns, so that using it twice costs nothing."""
        if term.constant is not None or len(term.key) <= LONGEST_KEY:
            return term
        return self.column(term)

    # -- expressions

    def value(self, node, env: dict[str, Term], for_name: str = "") -> Term:
        match node:
            case Num(v):
                return constant(v)
            case Flag(b):
                return constant(1.0 if b else 0.0)
            case Text(s):
                return constant(s)
            case Name(n):
                return self.name(n, env)
            case Unary("-", v):
                t = self.numeric(self.value(v, env))
                return constant(-t.constant) if t.constant is not None else self.scalar("neg", [t], lambda x: -x)
            case Unary("not", v):
                return self.call("not", [self.value(v, env)])
            case Binary(op, a, b):
                return self.binary(op, self.numeric(self.value(a, env)), self.numeric(self.value(b, env)))
            case Back(base, offset):
                return self.call("ref", [self.value(base, env), self.value(offset, env)])
            case Call(n, args):
                return self.special(n, [self.value(a, env) for a in args], for_name)
        raise ScriptError(f"can't compile {node!r}")

    def name(self, n: str, env: dict[str, Term]) -> Term:
        if n in env:
            return env[n]
        known = n.lower() if self.script.language != "pine" else n
        if known in INPUTS:
            return self.input(INPUTS[known])
        if n.startswith("color."):
            return constant(n[len("color.") :])
        if n.lower().startswith("color"):
            return constant(n)
        raise ScriptError(f"unknown name {n!r}; inputs: {', '.join(sorted(self.available))}; variables: {', '.join(sorted(env)) or 'none'}")

    def input(self, column: str) -> Term:
        if column not in self.available:
            raise ScriptError(f"there is no input {column!r}; there are {', '.join(sorted(self.available))}")
        self.inputs[column] = None
        return Term(F.col(column), 0, column)

    def numeric(self, t: Term) -> Term:
        if isinstance(t.constant, str):
            raise ScriptError(f"the text {t.constant!r} stands where a number belongs")
        return t

    def binary(self, op: str, a: Term, b: Term) -> Term:
        if op in ("and", "or"):
            both = (lambda x, y: (x != 0) & (y != 0)) if op == "and" else (lambda x, y: (x != 0) | (y != 0))
            return self.scalar(op, [a, b], lambda x, y: F.when(x.isNotNull() & y.isNotNull(), number(both(x, y))))
        rules = {
            "+": lambda x, y: x + y,
            "-": lambda x, y: x - y,
            "*": lambda x, y: x * y,
            "/": lambda x, y: F.try_divide(x, y),
            "=": lambda x, y: number(x == y),
            "<>": lambda x, y: number(x != y),
            "<": lambda x, y: number(x < y),
            "<=": lambda x, y: number(x <= y),
            ">": lambda x, y: number(x > y),
            ">=": lambda x, y: number(x >= y),
        }
        if a.constant is not None and b.constant is not None and op in "+-*/" and (op != "/" or b.constant):
            x, y = a.constant, b.constant
            return constant({"+": x + y, "-": x - y, "*": x * y, "/": x / y if y else 0.0}[op])
        return self.scalar(op, [a, b], rules[op])

    def scalar(self, what: str, terms: list[Term], build) -> Term:
        key = f"{what}({','.join(t.key for t in terms)})"
        return Term(build(*[t.column for t in terms]), max([0, *(t.level for t in terms)]), key)

    # -- calls

    def special(self, n: str, args: list[Term], for_name: str) -> Term:
        arity = {"plot": (1, 2), **{f"plot{k}": (1, 2) for k in range(1, 6)}, "indicator": (1, 2), "input.int": (1, 2)}
        if n in arity:
            self.counted(n, len(args), *arity[n])
        if n.startswith("plot") and n in arity:
            title = args[1].constant if len(args) > 1 and isinstance(args[1].constant, str) else None
            name = title if title and self.script.language == "easylanguage" else n
            used = {o.name for o in [*self.outputs.values(), *self.plots]}
            name = name if name not in used else next(f"{name}_{k}" for k in range(2, 10**6) if f"{name}_{k}" not in used)
            term = self.numeric(args[0])
            self.plots.append(Output(name, term, (title or "blue",)))
            return term
        if n == "indicator":
            self.title = {"title": args[0].constant, "overlay": bool(args[1].constant) if len(args) > 1 else False}
            return constant(0.0)
        if n == "input.int":
            name = for_name or (args[1].constant if len(args) > 1 else f"input_{len(self.given) + 1}")
            value = self.parameters.get(name, args[0].constant)
            if value is None or isinstance(value, str):
                raise ScriptError("an input's default must be a number")
            self.given[name] = float(int(value))
            return constant(int(value))
        return self.call(n, args)

    def counted(self, name: str, got: int, least: int, most: int) -> None:
        if not least <= got <= most:
            raise ScriptError(f"{name}() takes {least if least == most else f'{least} to {most}'} arguments, not {got}")

    def call(self, name: str, args: list[Term]) -> Term:
        f = REGISTRY.get(name)
        if f is None:
            raise ScriptError(f"unknown function {name!r}; known: {', '.join(sorted(k for k in REGISTRY if k[0] != '_'))}")
        self.counted(name, len(args), f.least, f.most)
        args = [self.numeric(a) for a in args]
        if name == "sma" and self.weighted_sma:
            weight = self.binary("/", args[2], args[1])
            return self.fold("dma", [args[0], weight])
        if f.kind == "scalar":
            if name == "cost" and not args:
                return self.input("close")
            return self.scalar(name, args, f.build)
        if f.kind == "composed" and all(a.constant is not None for a in args[1:]):
            return f.build(self.call_on, *args)
        series = [k for k in f.lengths if args[k].constant is None] or f.kind == "composed"
        if f.kind == "fold" or series:
            return self.fold(name, args)
        self.indexed = True
        key = f"{name}({','.join(a.key for a in args)})"
        if key in self.made:
            return self.made[key]
        if f.kind == "terms":
            column = f.build(self.frames, *args)
        else:
            column = f.build(self.frames, *[int(a.constant) if k in f.lengths else a.column for k, a in enumerate(args)])
        return self.place(key, column, max([0, *(a.level for a in args)]))

    def call_on(self, name: str, *args: Term) -> Term:
        return self.call(name, list(args))

    def place(self, key: str, column: Column, level: int) -> Term:
        while len(self.stages) <= level:
            self.stages.append(Stage())
        name = f"_k{len(self.made)}"
        self.stages[level].columns[name] = column
        self.made[key] = Term(F.col(name), level + 1, name)
        return self.made[key]

    def column(self, term: Term) -> Term:
        return self.made.get(term.key) or self.place(term.key, term.column, term.level)

    def fold(self, name: str, args: list[Term]) -> Term:
        key = f"{name}({','.join(a.key for a in args)})"
        if key in self.made:
            return self.made[key]
        level = max([0, *(a.level for a in args)])
        while len(self.stages) <= level:
            self.stages.append(Stage())
        sources = []
        for a in args:
            if a.constant is not None:
                sources.append(a.constant)
                continue
            # Expressions are made columns by the same stage, just before its folds.
            temp = f"_a{len(self.made)}_{len(sources)}"
            self.stages[level].columns[temp] = a.column
            sources.append(temp)
        out = f"_k{len(self.made)}"
        self.stages[level].folds.append(Fold(name, sources, out))
        self.made[key] = Term(F.col(out), level + 1, out)
        return self.made[key]

