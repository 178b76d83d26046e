"""Expressions over one ordered series.

An operator is a small graph of nodes: input columns, row functions, lags, rolling and running
aggregates, windows with a function of their own, and ordered recursions (``scan``). The same
graph is evaluated in three ways:

* ``spark.columns``: Catalyst window expressions, where no node needs Python;
* ``evaluate``: arrays of one key's rows, inside a grouped Arrow kernel;
* ``Stepper``: one row at a time with carried state, for streams.

A missing value is NaN in arrays and NULL in Spark. Row functions are strict: a missing argument
gives a missing result, also in conditions. Rolling aggregates over n rows are missing until n
values are there.
"""

from __future__ import annotations

import builtins
import math
from collections import deque
from collections.abc import Callable

import numpy as np

NAN = float("nan")


class Interned(dict):
    """Nodes by what defines them; travels empty to workers."""

    def __reduce__(self):
        return Interned, ()


_MADE = Interned()


def intern(kind: str, args: tuple = (), param=None) -> Node:
    """The node of that kind; equal definitions give one node."""
    key = (kind, tuple(id(a) for a in args), param)
    if key not in _MADE:
        _MADE[key] = Node(kind, args, param)
    return _MADE[key]


class Node:
    __slots__ = ("kind", "args", "param")

    def __init__(self, kind: str, args: tuple, param):
        self.kind, self.args, self.param = kind, args, param

    def __add__(self, b): return fn("add", self, b)
    def __radd__(self, b): return fn("add", b, self)
    def __sub__(self, b): return fn("sub", self, b)
    def __rsub__(self, b): return fn("sub", b, self)
    def __mul__(self, b): return fn("mul", self, b)
    def __rmul__(self, b): return fn("mul", b, self)
    def __truediv__(self, b): return fn("div", self, b)
    def __rtruediv__(self, b): return fn("div", b, self)
    def __neg__(self): return fn("sub", 0.0, self)
    def __abs__(self): return fn("abs", self)
    def __gt__(self, b): return fn("gt", self, b)
    def __ge__(self, b): return fn("ge", self, b)
    def __lt__(self, b): return fn("gt", b, self)
    def __le__(self, b): return fn("ge", b, self)
    def __and__(self, b): return fn("and", self, b)
    def __or__(self, b): return fn("or", self, b)
    def __invert__(self): return fn("not", self)
    def __pow__(self, b): return fn("pow", self, b)


def node(x) -> Node:
    return x if isinstance(x, Node) else intern("lit", (), float(x))


def col(name: str) -> Node:
    return intern("col", (), name)


def fn(name: str, *args) -> Node:
    return intern("fn", tuple(node(a) for a in args), name)


def eq(a, b): return fn("eq", a, b)
def ne(a, b): return ~fn("eq", a, b)
def where(c, a, b): return fn("where", c, a, b)
def cases(*pairs): return where(pairs[0], pairs[1], cases(*pairs[2:]) if len(pairs) > 3 else pairs[2])
def div(a, b, zero=0.0): return where(eq(b, 0.0), zero, fn("div", a, b))
def mx(*xs): return xs[0] if len(xs) == 1 else fn("max", xs[0], mx(*xs[1:]))
def mn(*xs): return xs[0] if len(xs) == 1 else fn("min", xs[0], mn(*xs[1:]))
def abs(x): return builtins.abs(x) if not isinstance(x, Node) else fn("abs", x)
def clamp(x, lo, hi): return mn(mx(node(x), node(lo)), node(hi))
def sqrt(x): return fn("sqrt", x)
def ln(x): return fn("ln", x)
def exp(x): return fn("exp", x)
def sign(x): return fn("sign", x)
def both(x, y): return where(eq(y, y), x, x)
def only(c, x): return fn("only", c, x)


def lag(x, k: int = 1) -> Node:
    return node(x) if k == 0 else intern("lag", (node(x),), int(k))


def roll(kind: str, n: int, *xs, q: float | None = None) -> Node:
    if int(n) < 1:
        raise ValueError("period must be at least 1")
    if kind in ("max", "min", "avg") and int(n) == 1:
        return node(xs[0])
    return intern("roll", tuple(node(x) for x in xs), (kind, int(n), q))


def rsum(x, n): return roll("sum", n, x)
def ravg(x, n): return roll("avg", n, x)
def rmax(x, n): return roll("max", n, x)
def rmin(x, n): return roll("min", n, x)
def rstd(x, n): return roll("std", n, x)
def rstds(x, n): return roll("stds", n, x)
def rvar(x, n): return roll("var", n, x)
def rcov(x, y, n): return roll("cov", n, x, y)
def rq(x, n, q): return roll("q", n, x, q=q)
def slope(x, n): return roll("slope", n, x)


def weighted(x, weights) -> Node:
    """Sum of the last len(weights) values times the weights, the oldest first."""
    return intern("weighted", (node(x),), tuple(float(w) for w in weights))


def window(f: Callable, n: int, *xs, outs: int = 1, tag=()) -> Node:
    """f(arrays of the last n rows) -> float or tuple; ``tag`` and f's name identify it."""
    return intern("window", tuple(node(x) for x in xs), (Tagged(f, (f.__qualname__, tag)), int(n), outs))


def cum(kind: str, x=1.0) -> Node:
    """Running sum, max or min (missing values are passed over, the result is missing there), or ``fill``: the last value so far."""
    return intern("cum", (node(x),), kind)


def csum(x): return cum("sum", x)
def cmax(x): return cum("max", x)
def cmin(x): return cum("min", x)
def fill(x): return cum("fill", x)
def rownum(): return cum("sum", where(eq(col("_valid"), 1.0), 1.0, 1.0))


class Tagged:
    """A callable compared by a tag, so that equal nodes are one node."""

    def __init__(self, f, tag):
        self.f, self.tag = f, tag

    def __eq__(self, other): return isinstance(other, Tagged) and self.tag == other.tag
    def __hash__(self): return hash(self.tag)
    def __call__(self, *a): return self.f(*a)


def scan(make: Callable, *xs, outs: int = 1, tag=()) -> Node:
    """An ordered recursion: make() gives step(*values) -> float, tuple or None. Rows with a missing value are passed over."""
    return intern("scan", tuple(node(x) for x in xs), (Tagged(make, (make.__qualname__, make.__module__, tag)), outs))


def pick(x: Node, i: int) -> Node:
    return intern("pick", (x,), i)


def picks(x: Node, names: str) -> dict[str, Node]:
    return {n: pick(x, i) for i, n in enumerate(names.split())}


# ---- recursions that many operators use


def ema(x, n: int | None = None, alpha: float | None = None) -> Node:
    """Seeded with the mean of the first n values, then alpha x + (1 - alpha) y; alpha alone: seeded with the first value."""
    a, m = (2.0 / (n + 1) if alpha is None else alpha), (n or 1)
    if m < 1:
        raise ValueError("period must be at least 1")

    def make():
        k, s = 0, 0.0

        def step(x):
            nonlocal k, s
            if k < m:
                k += 1
                s += x
                if k < m:
                    return None
                s /= m
                return s
            s = a * x + (1 - a) * s
            return s

        return step

    return scan(make, x, tag=("ema", m, a))


def rma(x, n: int) -> Node:
    """Wilder's average: mean of the first n, then (y (n - 1) + x) / n."""
    return ema(x, n, 1.0 / n)


def wsum(x, n: int) -> Node:
    """Wilder's sum: sum of the first n, then y - y / n + x."""

    def make():
        k, s = 0, 0.0

        def step(x):
            nonlocal k, s
            if k < n:
                k += 1
                s += x
                return s if k == n else None
            s = s - s / n + x
            return s

        return step

    return scan(make, x, tag=("wsum", n))


def wma(x, n: int) -> Node:
    return weighted(x, [k * 2.0 / (n * (n + 1)) for k in range(1, n + 1)])


def rsi(x, n: int, flat: float = 50.0) -> Node:
    d = node(x) - lag(x)
    g, l = rma(mx(d, 0.0), n), rma(mx(-d, 0.0), n)  # noqa: E741
    return div(100.0 * g, g + l, flat)


# ---------------------------------------------------------------- array evaluation


def _strict(f):
    def g(*a):
        with np.errstate(all="ignore"):
            out = f(*a).astype(float)
        for x in a:
            out = np.where(np.isnan(x), NAN, out)
        return out

    return g


def _where(c, a, b):
    return np.where(np.isnan(c), NAN, np.where(c != 0, a, b))


def _div(a, b):
    with np.errstate(all="ignore"):
        return np.where(b == 0, NAN, a / b)


FN: dict[str, Callable] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": _div,
    "abs": np.abs, "gt": _strict(lambda a, b: a > b), "ge": _strict(lambda a, b: a >= b), "eq": _strict(lambda a, b: a == b),
    "and": _strict(lambda a, b: (a != 0) & (b != 0)), "or": _strict(lambda a, b: (a != 0) | (b != 0)), "not": _strict(lambda a: a == 0),
    "where": _where, "only": lambda c, x: np.where(c == 1, x, NAN), "max": lambda a, b: np.maximum(a, b), "min": lambda a, b: np.minimum(a, b),
    "sqrt": _strict(lambda a: np.sqrt(np.maximum(a, 0))), "ln": lambda a: np.log(np.where(a > 0, a, NAN)), "exp": _strict(np.exp), "sign": np.sign,
    "pow": _strict(lambda a, b: np.power(a, b)), "tanh": np.tanh, "atan": np.arctan, "sin": np.sin, "cos": np.cos, "floor": np.floor, "ceil": np.ceil, "round": np.round,
    "atan2": np.arctan2, "log10": lambda a: np.log10(np.where(a > 0, a, NAN)), "isnull": lambda a: np.isnan(a).astype(float), "coalesce": lambda a, b: np.where(np.isnan(a), b, a),
}


def _slope(w):
    n = w.shape[1]
    k = np.arange(n) - (n - 1) / 2
    return (w - w[:, :1]) @ k / (n * (n * n - 1) / 12) if n > 1 else np.zeros(len(w)) + 0 * w[:, 0]


def _moment(w, p):
    d = w - w.mean(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        m2 = (d**2).mean(axis=1)
        return np.where(m2 == 0, 0.0, (d**p).mean(axis=1) / m2 ** (p / 2) - (3 if p == 4 else 0)) + 0 * m2


def _quantile(w, q):
    s = np.sort(w, axis=1)
    h = (w.shape[1] - 1) * q
    i = int(math.floor(h))
    j = min(i + 1, w.shape[1] - 1)
    return s[:, i] + (h - i) * (s[:, j] - s[:, i]) + 0 * w.sum(axis=1)


ROLL: dict[str, Callable] = {
    "sum": lambda w, q: w.sum(axis=1), "avg": lambda w, q: w.mean(axis=1), "max": lambda w, q: w.max(axis=1), "min": lambda w, q: w.min(axis=1),
    "var": lambda w, q: w.var(axis=1), "std": lambda w, q: w.std(axis=1), "vars": lambda w, q: w.var(axis=1, ddof=1), "stds": lambda w, q: w.std(axis=1, ddof=1),
    "cov": lambda w, q, v: ((w - w.mean(axis=1, keepdims=True)) * (v - v.mean(axis=1, keepdims=True))).mean(axis=1),
    "skew": lambda w, q: _moment(w, 3), "kurt": lambda w, q: _moment(w, 4), "q": _quantile, "slope": lambda w, q: _slope(w),
}


def _rolled(kind, n, q, xs, chunk=1 << 16):
    size = len(xs[0])
    out = np.full(size, NAN)
    for at in range(n - 1, size, chunk):
        end = min(size, at + chunk)
        ws = [np.lib.stride_tricks.sliding_window_view(x[at - n + 1 : end], n) for x in xs]
        with np.errstate(all="ignore"):
            got = ROLL[kind](ws[0], q, *ws[1:])
        ok = np.ones(end - at, bool)
        for w in ws:
            ok &= ~np.isnan(w).any(axis=1)
        out[at:end] = np.where(ok, got, NAN)
    return out


def _cumulated(kind, x):
    if kind == "fill":
        i = np.where(np.isnan(x), 0, np.arange(len(x)))
        return x[np.maximum.accumulate(i)] if len(x) else x
    ok = ~np.isnan(x)
    y = np.where(ok, x, {"sum": 0.0, "max": -np.inf, "min": np.inf}[kind])
    acc = {"sum": np.cumsum, "max": np.maximum.accumulate, "min": np.minimum.accumulate}[kind](y)
    return np.where(ok, acc, NAN)


def _looped(step, outs, xs):
    n = len(xs[0])
    ok = ~np.isnan(np.stack(xs)).any(axis=0)
    rows = zip(*(x.tolist() for x in xs), strict=True)
    if outs == 1:
        return np.array([NAN if not k or (y := step(*r)) is None else y for k, r in zip(ok.tolist(), rows, strict=True)], float)
    out = np.full((outs, n), NAN)
    for i, (k, r) in enumerate(zip(ok.tolist(), rows, strict=True)):
        if k and (y := step(*r)) is not None:
            out[:, i] = y
    return out


def evaluate(nodes: list[Node], cols: dict[str, np.ndarray], size: int) -> list[np.ndarray]:
    """Arrays of the nodes over one series; cols: input arrays of that length."""
    done: dict[int, np.ndarray] = {}

    def of(x: Node) -> np.ndarray:
        if id(x) in done:
            return done[id(x)]
        a = [of(y) for y in x.args]
        k, p = x.kind, x.param
        if k == "lit":
            r = np.full(size, p)
        elif k == "col":
            r = np.ones(size) if p == "_valid" else cols[p]
        elif k == "fn":
            with np.errstate(all="ignore"):
                r = FN[p](*a)
        elif k == "lag":
            r = np.concatenate((np.full(min(p, size), NAN), a[0][: max(size - p, 0)]))
        elif k == "roll":
            r = _rolled(*p, a)
        elif k == "weighted":
            n = len(p)
            r = np.full(size, NAN)
            if size >= n:
                r[n - 1 :] = np.lib.stride_tricks.sliding_window_view(a[0], n) @ np.array(p)
        elif k == "window":
            f, n, outs = p
            r = np.full((outs, size), NAN)
            ok = np.cumsum(np.concatenate(([0], np.isnan(np.stack(a)).any(axis=0))))
            for i in range(n - 1, size):
                if ok[i + 1] == ok[i + 1 - n] and (y := f(*(x[i + 1 - n : i + 1] for x in a))) is not None:
                    r[:, i] = y
            r = r if outs > 1 else r[0]
        elif k == "cum":
            r = _cumulated(p, a[0])
        elif k == "scan":
            r = _looped(p[0].f(), p[1], a) if size else np.empty((p[1], 0) if p[1] > 1 else 0)
        elif k == "pick":
            r = a[0][p]
        else:
            raise KeyError(k)
        done[id(x)] = r
        return r

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))
    return [of(x) for x in nodes]


# ---------------------------------------------------------------- one row at a time


class Stepper:
    """The same nodes over rows that arrive one after another; picklable with cloudpickle between rows."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.order, seen = nodes, [], set()

        def visit(x: Node) -> None:
            if id(x) not in seen:
                seen.add(id(x))
                for y in x.args:
                    visit(y)
                self.order.append(x)

        for x in nodes:
            visit(x)
        at = {id(x): i for i, x in enumerate(self.order)}
        self.places = [tuple(at[id(y)] for y in x.args) for x in self.order]
        self.out = [at[id(x)] for x in nodes]
        self.state = [self._start(x) for x in self.order]

    @staticmethod
    def _start(x: Node):
        if x.kind == "lag":
            return deque([NAN] * x.param, maxlen=x.param + 1)
        if x.kind in ("roll", "window"):
            return deque(maxlen=x.param[1])
        if x.kind == "weighted":
            return deque(maxlen=len(x.param))
        if x.kind == "scan":
            return x.param[0].f()
        return [NAN]

    def step(self, row: dict[str, float]) -> list[float]:
        v: list = [NAN] * len(self.order)
        for i, x in enumerate(self.order):
            a = [v[j] for j in self.places[i]]
            k, p, s = x.kind, x.param, self.state[i]
            if k == "lit":
                y = p
            elif k == "col":
                y = 1.0 if p == "_valid" else row[p]
            elif k == "fn":
                with np.errstate(all="ignore"):
                    y = float(FN[p](*(np.float64(z) for z in a)))
            elif k == "lag":
                s.append(a[0])
                y = s[0]
            elif k in ("roll", "window", "weighted"):
                s.append(tuple(a))
                y = NAN
                if len(s) == s.maxlen:
                    cols = np.array(s, float).T
                    if not np.isnan(cols).any():
                        with np.errstate(all="ignore"):
                            if k == "roll":
                                y = float(ROLL[p[0]](cols[:1], p[2], *(c[None, :] for c in cols[1:]))[0])
                            elif k == "weighted":
                                y = float(cols[0] @ np.array(p))
                            else:
                                got = p[0](*cols)
                                y = NAN if got is None else got
            elif k == "cum":
                if a[0] == a[0]:
                    o = s[0]
                    s[0] = a[0] if o != o or p == "fill" else {"sum": o + a[0], "max": max(o, a[0]), "min": min(o, a[0])}[p]
                y = s[0] if a[0] == a[0] or p == "fill" else NAN
            elif k == "scan":
                y = NAN
                if all(z == z for z in a):
                    got = s(*a)
                    y = NAN if got is None else got
            else:
                y = a[0][p] if isinstance(a[0], tuple | list | np.ndarray) else NAN
            v[i] = y
        return [float(v[j]) for j in self.out]
