"""Precedence parsers of the three dialects: formula ("hithink"), "easylanguage" and "pine"."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tickloom.plans.tree import Assign, Back, Binary, Call, Declare, Evaluate, Flag, If, Name, Num, Script, ScriptError, Text, Unary


@dataclass(frozen=True)
class Dialect:
    name: str
    comment: str
    signs: str
    words: frozenset
    fold: bool  # keywords and function names in any case
    quotes: str
    letters: str
    levels: tuple[tuple[str, ...], ...]
    spell: dict


_ANY, _ASCII = r"[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*", r"[A-Za-z_][A-Za-z0-9_]*"
_COMPARE = ("=", "<>", "<", "<=", ">", ">=")
DIALECTS = {
    "hithink": Dialect("hithink", r"\{[^}]*\}?|//[^\n]*", r":=|<>|<=|>=|==|!=|[-+*/()\[\],;:<>=]", frozenset({"select", "and", "or"}), True, r"'[^']*'|\"[^\"]*\"", _ANY, (("or",), ("and",), _COMPARE, ("+", "-"), ("*", "/")), {"==": "=", "!=": "<>"}),
    "easylanguage": Dialect("easylanguage", r"\{[^}]*\}?|//[^\n]*", r"<>|<=|>=|[-+*/()\[\],;:<>=]", frozenset("if then else begin end variables vars inputs and or not true false".split()), True, r"'[^']*'|\"[^\"]*\"", _ANY, (("or",), ("and",), ("=", "<>"), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/")), {}),
    "pine": Dialect("pine", r"//[^\n]*", r":=|==|!=|<=|>=|[-+*/()\[\]{},.;=<>?:]", frozenset("if else and or not true false".split()), False, r"\"[^\"]*\"|'[^']*'", _ASCII, (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/")), {"==": "=", "!=": "<>"}),
}
MOST_ARGUMENTS = 255
_ALIASES = {"hithink": "hithink", "tdx": "hithink", "easylanguage": "easylanguage", "el": "easylanguage", "pine": "pine"}


@dataclass
class Token:
    kind: str  # number, text, name, word, sign, line, end
    text: str
    line: int


def tokens(source: str, d: Dialect) -> list[Token]:
    pattern = re.compile(rf"(?P<comment>{d.comment})|(?P<number>\d+(?:\.\d+)?)|(?P<text>{d.quotes})|(?P<name>{d.letters})|(?P<sign>{d.signs})|(?P<line>\n)|(?P<blank>[ \t\r﻿]+)|(?P<bad>.)")
    out, line = [], 1
    for m in pattern.finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind == "bad":
            raise ScriptError(f"line {line}: unexpected character {text!r}")
        if kind == "name" and (text.lower() if d.fold else text) in d.words:
            kind, text = "word", text.lower()
        if kind == "text":
            text = text[1:-1]
        if kind not in ("comment", "blank"):
            out.append(Token(kind, text, line))
        line += m.group().count("\n")
    return [*out, Token("end", "", line)]


class Parser:
    def __init__(self, source: str, language: str) -> None:
        self.d = DIALECTS[language]
        self.all, self.at, self.inside = tokens(source, self.d), 0, 0

    # -- tokens; line ends count in formulas only, outside brackets

    def peek(self) -> Token:
        while self.all[self.at].kind == "line" and (self.inside or self.d.name != "hithink"):
            self.at += 1
        return self.all[self.at]

    def take(self) -> Token:
        t = self.peek()
        self.at += t.kind != "end"
        return t

    def have(self, *texts: str) -> bool:
        t = self.peek()
        if t.kind in ("sign", "word") and t.text in texts:
            self.take()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.have(text):
            self.fail(f"expected {text!r}")

    def fail(self, what: str):
        t = self.peek()
        raise ScriptError(f"line {t.line}: {what}, found {t.text or 'the end'!r}")

    def ahead(self, k: int) -> Token:
        return self.all[min(self.at + k, len(self.all) - 1)]

    # -- expressions

    def expression(self, level: int = 0):
        if level == len(self.d.levels):
            return self.unary()
        left = self.expression(level + 1)
        while (t := self.peek()).kind in ("sign", "word") and t.text in self.d.levels[level]:
            self.take()
            left = Binary(self.d.spell.get(t.text, t.text), left, self.expression(level + 1))
        return left

    def unary(self):
        if self.have("-"):
            return Unary("-", self.unary())
        if self.have("not"):
            return Unary("not", self.unary())
        return self.postfix()

    def postfix(self):
        node = self.primary()
        while True:
            if self.have("["):
                self.inside += 1
                offset = self.expression()
                self.need("]")
                self.inside -= 1
                node = Back(node, offset)
            elif self.peek().text == "(" and isinstance(node, Name) and self.peek().kind == "sign":
                self.take()
                node = Call(node.name if self.d.name == "pine" else node.name.lower(), self.arguments())
            elif self.d.name == "pine" and isinstance(node, Name) and self.have("."):
                t = self.take()
                node = Name(f"{node.name}.{t.text}")
            else:
                return node

    def arguments(self) -> tuple:
        args = []
        self.inside += 1
        if not self.have(")"):
            while True:
                # Named arguments are taken by position.
                if self.d.name == "pine" and self.peek().kind == "name" and self.ahead(1).text == "=":
                    self.take(), self.take()
                args.append(self.expression())
                if not self.have(","):
                    break
            self.need(")")
        self.inside -= 1
        if len(args) > MOST_ARGUMENTS and self.d.name != "pine":
            self.fail(f"more than {MOST_ARGUMENTS} arguments")
        return tuple(args)

    def primary(self):
        t = self.peek()
        if t.kind == "number":
            return Num(float(self.take().text))
        if t.kind == "text":
            return Text(self.take().text)
        if t.kind == "name":
            return Name(self.take().text)
        if t.kind == "word" and t.text in ("true", "false"):
            return Flag(self.take().text == "true")
        if self.have("("):
            self.inside += 1
            node = self.expression()
            self.need(")")
            self.inside -= 1
            return node
        return self.fail("expected a value")

    # -- statements

    def script(self) -> Script:
        out, step = Script(self.d.name), {"hithink": self.formula, "easylanguage": self.easy, "pine": self.pine}[self.d.name]
        while self.peek().kind != "end":
            s = step()
            if s is not None:
                out.body += s if isinstance(s, list) else [s]
        return out

    def formula(self):
        if self.have(";") or (self.peek().kind == "line" and self.take()):
            return None
        if self.have("select"):
            out = Assign("select", self.expression(), True)
        elif self.peek().kind == "name" and self.ahead(1).text in (":", ":=") and self.ahead(1).kind == "sign":
            name, output = self.take().text, self.take().text == ":"
            out = Assign(name, self.expression(), output)
        else:
            out = Evaluate(self.expression())
        style = []
        while self.have(","):
            style.append(self.take().text)
        if self.peek().kind not in ("line", "end") and not self.have(";"):
            self.fail("expected the end of the statement")
        if style:
            out = Assign(out.name, out.value, out.output, tuple(style)) if isinstance(out, Assign) else out
        return out

    def easy(self):
        if self.have(";"):
            return None
        t = self.peek()
        if self.have("inputs", "variables", "vars"):
            self.need(":")
            out = []
            while True:
                name, value = self.take(), Num(0.0)
                if name.kind != "name":
                    self.fail("expected a name")
                if self.have("("):
                    value = self.expression()
                    self.need(")")
                out.append(Declare(name.text, value, t.text == "inputs"))
                if not self.have(","):
                    break
            self.need(";")
            return out
        if self.have("if"):
            test = self.expression()
            self.need("then")
            then = self.easy_block()
            return If(test, then, self.easy_block() if self.have("else") else ())
        if t.kind == "name" and self.next_sign() == "=":
            name = self.take().text
            self.need("=")
            out = Assign(name, self.expression())
        else:
            out = Evaluate(self.expression())
        if not self.have(";") and self.peek().text not in ("end", "else"):
            self.fail("expected ';'")
        return out

    def next_sign(self) -> str:
        k = 1
        while self.ahead(k).kind == "line":
            k += 1
        return self.ahead(k).text if self.ahead(k).kind == "sign" else ""

    def easy_block(self) -> tuple:
        if self.have("begin"):
            out = []
            while not self.have("end"):
                if self.peek().kind == "end":
                    self.fail("expected 'end'")
                s = self.easy()
                out += s if isinstance(s, list) else [s] if s is not None else []
            self.have(";")
            return tuple(out)
        s = self.easy()
        return tuple(s if isinstance(s, list) else [s] if s is not None else ())

    def pine(self):
        if self.have(";"):
            return None
        if self.have("if"):
            test = self.expression()
            then = self.pine_block()
            return If(test, then, (self.pine(),) if self.peek().text == "if" else self.pine_block()) if self.have("else") else If(test, then)
        if self.peek().kind == "name" and self.next_sign() in ("=", ":="):
            name = self.take().text
            self.take()
            return Assign(name, self.expression())
        return Evaluate(self.expression())

    def pine_block(self) -> tuple:
        self.need("{")
        out = []
        while not self.have("}"):
            if self.peek().kind == "end":
                self.fail("expected '}'")
            s = self.pine()
            out += [s] if s is not None else []
        return tuple(out)


def parse(source: str, language: str = "hithink") -> Script:
    """The tree of a script; language: hithink (or tdx), easylanguage (or el), pine."""
    if language not in _ALIASES:
        raise ScriptError(f"unknown language {language!r}; known: {', '.join(_ALIASES)}")
    return Parser(source, _ALIASES[language]).script()
