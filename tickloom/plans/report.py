"""Checking many scripts at once: which compile, and why the others don't."""

from __future__ import annotations

from dataclasses import dataclass

import tickloom.functions  # noqa: F401
from tickloom.operators.run import plan
from tickloom.plans.tree import ScriptError

#: Languages by the endings of file names.
ENDINGS = {"pine": "pine", "el": "easylanguage", "hithink": "hithink", "tdx": "hithink"}
COLUMNS = ["time", "date", "open", "high", "low", "close", "volume", "amount"]


@dataclass(frozen=True)
class Report:
    scripts: int
    good: int
    failures: tuple[tuple[int, str], ...]  # line, reason


def language_of(path: str) -> str:
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in ENDINGS:
        raise ScriptError(f"no language has the ending {ending!r}; known: {', '.join(ENDINGS)}")
    return ENDINGS[ending]


def check_lines(text: str, language: str = "hithink") -> Report:
    """Each line that isn't blank is a script of its own; none is run. Needs an active Spark session."""
    lines = [(k, line) for k, line in enumerate(text.splitlines(), 1) if line.strip()]
    failures = []
    for k, line in lines:
        try:
            plan(line, COLUMNS, language)
        except ScriptError as e:
            failures.append((k, str(e)))
    return Report(len(lines), len(lines) - len(failures), tuple(failures))


def check_file(path: str) -> Report:
    with open(path, encoding="utf-8") as f:
        return check_lines(f.read(), language_of(path))
