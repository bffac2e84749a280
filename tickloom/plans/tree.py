"""The syntax tree that all dialects share."""

from __future__ import annotations

from dataclasses import dataclass, field


class ScriptError(ValueError):
    """A script that can't be parsed or compiled; says where and why."""


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Flag:
    value: bool


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Unary:
    op: str
    value: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Back:
    """base[offset]: the value `offset` bars ago."""

    base: object
    offset: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object
    output: bool = False
    style: tuple[str, ...] = ()


@dataclass(frozen=True)
class Evaluate:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple = ()


@dataclass(frozen=True)
class Declare:
    """An input (a parameter) or a variable with its first value."""

    name: str
    value: object
    parameter: bool


@dataclass
class Script:
    language: str
    body: list = field(default_factory=list)


_RANK = {"or": 1, "and": 2, "=": 3, "<>": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6}


def show(node, above: int = 0) -> str:
    """An expression as text that parses to the same tree."""
    match node:
        case Num(v):
            return format(v, ".17g") if "e" not in format(v, ".17g") else format(v, ".20f").rstrip("0")
        case Text(s):
            return f"'{s}'"
        case Flag(b):
            return "true" if b else "false"
        case Name(n):
            return n
        case Unary(op, v):
            return f"-{show(v, 7)}" if op == "-" else f"NOT({show(v)})"
        case Binary(op, a, b):
            r = _RANK[op]
            word = f" {op.upper() if op.isalpha() else op} "
            text = show(a, r) + word + show(b, r + 1)
            return f"({text})" if r < above else text
        case Call(n, args):
            return f"{n.upper()}({', '.join(map(show, args))})"
        case Back(base, k):
            return f"{show(base, 8)}[{show(k)}]"
    raise TypeError(node)


def pretty(script: Script) -> str:
    """A formula script with one statement a line, which parses to the same tree (assignments and expressions)."""
    lines = []
    for s in script.body:
        if isinstance(s, Assign):
            lines.append(f"{s.name}{':' if s.output else ':='} {show(s.value)}{''.join(', ' + x for x in s.style)};")
        elif isinstance(s, Evaluate):
            lines.append(f"{show(s.value)};")
        elif isinstance(s, Declare):
            lines.append(f"{s.name} := {show(s.value)};")
        else:
            raise ScriptError("statements with branches have no formula form")
    return "\n".join(lines)
