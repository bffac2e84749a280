"""Functions whose value depends on their own value one bar before: folds over the bars of an instrument."""

from __future__ import annotations

from tickloom.functions.registry import register

for _name, _args in {"filter": 2, "ema": 2, "expma": 2, "ta.ema": 2, "expmema": 2, "mema": 2, "xma": 2, "ama": 2, "dma": 2, "rsi": 2, "ta.rsi": 2}.items():
    register(_name, args=_args, kind="fold")(None)
