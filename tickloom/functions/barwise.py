"""The rules bar by bar, for what frames can't express: own values before, lengths that are series, and streams.

A rule is f(a, i, own): a[k](j) is argument k at bar j, own(j) the function's own value at an earlier bar; missing is
None, also before the first bar.
"""

from __future__ import annotations

import math


def _t(x) -> bool:
    return x is not None and x != 0


def _n(a, k, i) -> int:
    x = a[k](i)
    return 0 if x is None else int(x)


def _got(a, i, n, skip=0):
    return [a[0](i - k) for k in range(skip, skip + n)]


def _whole(what, least=1):
    def rule(a, i, own):
        n = _n(a, 1, i)
        v = _got(a, i, max(n, 0))
        return None if n < least or None in v else what(v)

    return rule


def _part(what):
    def rule(a, i, own):
        v = [x for x in _got(a, i, max(_n(a, 1, i), 0)) if x is not None]
        return what(v) if v else None

    return rule


def _mean(v):
    return sum(v) / len(v)


def _dev2(v):
    m = _mean(v)
    return sum((x - m) ** 2 for x in v)


def _slope(v):
    n = len(v)
    t = [-k for k in range(n)]
    mt, mv = _mean(t), _mean(v)
    return sum((x - mt) * (y - mv) for x, y in zip(t, v, strict=True)) / sum((x - mt) ** 2 for x in t)


def _pine_sma(a, i, own):
    n = _n(a, 1, i)
    if n < 1 or i < n - 1:
        return None
    v = [x for x in _got(a, i, n) if x is not None]
    return _mean(v) if v else None


def _mular(a, i, own):
    n = _n(a, 1, i)
    if n == 0:
        x, before = a[0](i), own(i - 1)
        return None if x is None else x if i == 0 else None if before is None else before * x
    v = _got(a, i, max(n, 0))
    return None if None in v else math.prod(v)


def _available(a, i, n):
    return [a[0](i - k) for k in range(max(n, 0)) if i - k >= 0]


def _flag(x) -> float:
    return 1.0 if x else 0.0


def _every(a, i, own):
    n = _n(a, 1, i)
    return _flag(n < 1 or i >= n - 1 and all(map(_t, _available(a, i, n))))


def _extreme_bars(sign):
    def rule(a, i, own):
        v = [(sign * x, i - k) for k, x in enumerate(_got(a, i, max(_n(a, 1, i), 0))) if x is not None]
        return float(i - min(v)[1]) if v else -1.0

    return rule


def _nth(sign, position):
    def rule(a, i, own):
        n, m, t = (_n(a, k, i) for k in (1, 2, 3))
        v = sorted((sign * x, j) for j in range(i - n - m + 1, i - n + 1) if (x := a[0](j)) is not None)
        return None if t < 1 or len(v) < t else float(i - v[t - 1][1]) if position else sign * v[t - 1][0]

    return rule


def _tma(a, i, own):
    n = _n(a, 1, i)
    v = _got(a, i, max(2 * n - 1, 0))
    return None if n < 1 or None in v else _mean([_mean(v[k : k + n]) for k in range(n)])


def _covar(a, i, own):
    n = _n(a, 2, i)
    v = [(a[0](i - k), a[1](i - k)) for k in range(max(n, 0))]
    if n < 2 or any(None in p for p in v):
        return None
    mx, my = _mean([p[0] for p in v]), _mean([p[1] for p in v])
    return sum((x - mx) * (y - my) for x, y in v) / (n - 1)


def _last(a, i, own):
    start, end = _n(a, 1, i) or i, _n(a, 2, i) or 1
    return _flag(all(i - k >= 0 and _t(a[0](i - k)) for k in range(end, start - 1, -1)))


def _cross(both):
    def rule(a, i, own):
        x, y, px, py = a[0](i), a[1](i), a[0](i - 1), a[1](i - 1)
        return 0.0 if None in (x, y, px, py) else _flag(x > y and px <= py or both and x < y and px >= py)

    return rule


def _since(none):
    def rule(a, i, own):
        if _t(a[0](i)):
            return 0.0
        before = own(i - 1)
        return none if before is None or before < 0 else before + 1

    return rule


class SinceN:
    """Bars since the n-th last true one, or the first where there are fewer; keeps the bars of the last `most` trues."""

    def __init__(self) -> None:
        self.at, self.most = [], None

    def __call__(self, a, i, own):
        if _t(a[0](i)):
            self.at.append(i)
            if self.most is not None:
                del self.at[: -self.most]
        return float(i - self.at[-min(max(_n(a, 1, i), 1), len(self.at))]) if self.at else -1.0


def _valuewhen(a, i, own):
    c = a[0](i)
    return a[1](i) if c is None or c != 0 else own(i - 1)


def _filter(a, i, own):
    n = _n(a, 1, i)
    return 0.0 if any(_t(own(i - k)) for k in range(1, n) if i - k >= 0) else a[0](i)


def _smooth(step, seed=lambda a, i, n: a[0](i)):
    """Missing with a missing value, which starts it afresh."""

    def rule(a, i, own):
        x, before = a[0](i), own(i - 1)
        if x is None:
            return None
        if before is None:
            return seed(a, i, _n(a, 1, i))
        return step(x, before, a[1](i))

    return rule


def _first_mean(a, i, n):
    v = _got(a, i, max(n, 0))
    return None if n < 1 or None in v else _mean(v)


def _ema_step(x, p, n):
    return None if n is None else (2 * x + (int(n) - 1) * p) / (int(n) + 1)


def _slow_step(x, p, n):
    return None if n is None or int(n) == 0 else (x + (int(n) - 1) * p) / int(n)


def _weigh_step(x, p, w):
    return None if w is None else p + w * (x - p)


_expmema = _smooth(_ema_step, _first_mean)


def _pine_ema(a, i, own):
    x, p, n = a[0](i), own(i - 1), a[1](i)
    if i == 0:
        return x
    return None if x is None or p is None or n is None else p + 2 / (n + 1) * (x - p)


class Wilder:
    """Relative strength with Wilder's smoothing; keeps the mean gain and loss of its own call.

    The first n changes are averaged, later ones smoothed; a missing change gives a missing value and changes nothing.
    """

    def __init__(self) -> None:
        self.seen, self.gain, self.loss = 0, 0.0, 0.0

    def __call__(self, a, i, own):
        x, before, n = a[0](i), a[0](i - 1), _n(a, 1, i)
        if i == 0 or x is None or before is None or n < 1:
            return None
        up, down = max(x - before, 0.0), max(before - x, 0.0)
        self.seen += 1
        k = min(self.seen, n)
        self.gain += (up - self.gain) / k
        self.loss += (down - self.loss) / k
        if self.seen < n:
            return None
        return 100 - 100 / (1 + self.gain / (self.loss or 1e-10))


RULES = {
    "ma": _whole(_mean),
    "sma": _whole(_mean),
    "sum": _whole(sum),
    "std": _whole(lambda v: math.sqrt(_dev2(v) / (len(v) - 1)), 2),
    "var": _whole(lambda v: _dev2(v) / (len(v) - 1), 2),
    "stdp": _whole(lambda v: math.sqrt(_dev2(v) / len(v))),
    "varp": _whole(lambda v: _dev2(v) / len(v)),
    "slope": _whole(_slope, 2),
    "wma": _whole(lambda v: sum(x * (len(v) - k) for k, x in enumerate(v)) / (len(v) * (len(v) + 1) / 2)),
    "ta.sma": _pine_sma,
    "mular": _mular,
    "tma": _tma,
    "count": lambda a, i, own: float(sum(map(_t, _available(a, i, _n(a, 1, i))))),
    "exist": lambda a, i, own: _flag(any(map(_t, _available(a, i, _n(a, 1, i))))),
    "tfilt": lambda a, i, own: _flag(all(map(_t, _available(a, i, _n(a, 1, i))))),
    "every": _every,
    "hhv": _part(max),
    "llv": _part(min),
    "hv": lambda a, i, own: max((x for x in _got(a, i, max(_n(a, 1, i), 0), 1) if x is not None), default=None),
    "lv": lambda a, i, own: min((x for x in _got(a, i, max(_n(a, 1, i), 0), 1) if x is not None), default=None),
    "hhvbars": _extreme_bars(-1),
    "llvbars": _extreme_bars(1),
    "findhigh": _nth(-1, False),
    "findlow": _nth(1, False),
    "findhighbars": _nth(-1, True),
    "findlowbars": _nth(1, True),
    "ref": lambda a, i, own: None if a[1](i) is None else a[0](i - int(a[1](i))),
    "avedev": _part(lambda v: sum(abs(x - _mean(v)) for x in v) / len(v)),
    "devsq": _part(_dev2),
    "covar": _covar,
    "last": _last,
    "cross": _cross(True),
    "longcross": _cross(False),
    "barscount": lambda a, i, own: (own(i - 1) or 0.0) + (a[0](i) is not None),
    "barslast": _since(None),
    "barssince": _since(-1.0),
    "barssincen": SinceN,
    "barslastcount": lambda a, i, own: (own(i - 1) or 0.0) + 1 if _t(a[0](i)) else 0.0,
    "valuewhen": _valuewhen,
    "totalbarscount": lambda a, i, own: i + 1.0,
    "islastbar": lambda a, i, own: 1.0,
    "filter": _filter,
    "ema": _smooth(_ema_step),
    "ta.ema": _pine_ema,
    "expmema": _expmema,
    "mema": _smooth(_slow_step, _first_mean),
    "xma": _smooth(_slow_step),
    "ama": _smooth(_weigh_step),
    "dma": _smooth(_weigh_step),
    "rsi": Wilder,
}
RULES |= {b: RULES[a] for a, names in {"ma": ["average"], "sum": ["sumbars"], "std": ["stddev"], "exist": ["tfilter"], "ref": ["refv", "hod", "lod", "lowrange"], "barslastcount": ["barsstatus"], "ema": ["expma"], "rsi": ["ta.rsi"]}.items() for b in names}


def rule_of(name: str):
    """The rule of a function, with a state of its own where it has one."""
    r = RULES[name]
    return r() if isinstance(r, type) else r
