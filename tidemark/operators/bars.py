"""Alternative bars: 0 to n rows out for a row in. Each maker gives step(row) -> list of output tuples."""

from __future__ import annotations

import math
from dataclasses import dataclass

INF = float("inf")


@dataclass
class BarBuilder:
    name: str
    inputs: tuple[str, ...]
    fields: tuple[str, ...]
    make: object
    params: dict


BARS: dict[str, BarBuilder] = {}
OHLC = ("open", "high", "low", "close")


def bars(fields: str, inputs=("close",)):
    def add(f):
        import inspect

        BARS[f.__name__] = BarBuilder(f.__name__, tuple(inputs), tuple(fields.split()), f, {k: p.default for k, p in inspect.signature(f).parameters.items()})
        return f

    return add


def positive(*values):
    if any(not v > 0 for v in values):
        raise ValueError("bar sizes must be positive")


@bars("open close direction")
def RenkoBars(box_size=1.0):
    """A brick for every box beyond the level; a turn needs two boxes and starts one box back."""
    positive(box_size)
    level, way = None, 0

    def step(close):
        nonlocal level, way
        out = []
        if level is None:
            level = close
            return out
        while True:
            move = (close - level) / box_size
            d = 1 if move >= 1 else -1 if move <= -1 else 0
            if not d or (way and d != way and abs(move) < 2):
                return out
            start = level if way in (0, d) else level + d * box_size
            level = start + d * box_size
            out.append((start, level, float(d)))
            way = d

    return step


@bars("start end direction")
def KagiBars(reversal=1.0):
    """A line ends when the close turns back from its extreme by the reversal."""
    positive(reversal)
    start = far = None
    way = 0

    def step(close):
        nonlocal start, far, way
        if far is None:
            start = far = close
            return []
        if way == 0:
            way = (close > far) - (close < far)
            far = close if way else far
            return []
        if (close - far) * way > 0:
            far = close
        elif (far - close) * way >= reversal:
            out = [(start, far, float(way))]
            start, far, way = far, close, -way
            return out
        return []

    return step


@bars("direction high low")
def PointAndFigureBars(box_size=1.0, reversal=3):
    """Columns of whole boxes; a column ends when price turns by ``reversal`` boxes."""
    positive(box_size, reversal)
    top = low = None
    way = 0

    def step(close):
        nonlocal top, low, way
        p = math.floor(close / box_size) * box_size
        if top is None:
            top = low = p
        elif way == 0:
            if p >= top + box_size:
                way, top = 1, p
            elif p <= low - box_size:
                way, low = -1, p
        elif way > 0:
            if p > top:
                top = p
            elif p <= top - reversal * box_size:
                out = [(1.0, top, low)]
                way, top, low = -1, top - box_size, p
                return out
        elif p < low:
            low = p
        elif p >= low + reversal * box_size:
            out = [(-1.0, top, low)]
            way, low, top = 1, low + box_size, p
            return out
        return []

    return step


@bars("open close direction")
def RangeBars(range_=1.0):
    """A bar for every whole range that the close moves from the anchor."""
    positive(range_)
    anchor = None

    def step(close):
        nonlocal anchor
        out = []
        if anchor is None:
            anchor = close
            return out
        for d in (1, -1):
            while (close - anchor) * d >= range_:
                out.append((anchor, anchor + d * range_, float(d)))
                anchor += d * range_
        return out

    return step


def gathered(done, fields, extra=lambda s: (), volume=True):
    """Merges rows into one bar until done(state, row) says that it is full; the overshoot is not carried on."""
    s: dict = {}

    def step(o, h, l, c, *rest):  # noqa: E741
        if not s.get("n"):
            s.update(o=o, h=h, l=l, v=0.0, n=0)
        s["h"], s["l"], s["n"] = max(s["h"], h), min(s["l"], l), s["n"] + 1
        if volume:
            s["v"] += rest[0]
        if not done(s, (o, h, l, c, *rest)):
            return []
        out = [(s["o"], s["h"], s["l"], c, *((s["v"],) if volume else ()), *extra(s))]
        s["n"] = 0
        return out

    return step


@bars("open high low close volume", (*OHLC, "volume"))
def TickBars(ticks=10):
    positive(ticks)
    return gathered(lambda s, r: s["n"] >= ticks, 5)


@bars("open high low close volume", (*OHLC, "volume"))
def VolumeBars(volume_per_bar=1000.0):
    positive(volume_per_bar)
    return gathered(lambda s, r: s["v"] >= volume_per_bar, 5)


@bars("open high low close volume dollar", (*OHLC, "volume"))
def DollarBars(dollar_per_bar=100_000.0):
    positive(dollar_per_bar)

    def done(s, r):
        s["d"] = (s["d"] if s["n"] > 1 else 0.0) + r[3] * r[4]
        return s["d"] >= dollar_per_bar

    return gathered(done, 6, lambda s: (s["d"],))


@bars("open high low close imbalance direction", OHLC)
def ImbalanceBars(threshold=5.0):
    """Closes when the summed signs of close changes (an equal close repeats the last sign) reach the threshold."""
    positive(threshold)
    prev, sign, theta = None, 0, 0.0

    def done(s, r):
        nonlocal prev, sign, theta
        if prev is not None:
            sign = 1 if r[3] > prev else -1 if r[3] < prev else sign
            theta += sign
        prev = r[3]
        if abs(theta) < threshold:
            return False
        s["theta"], theta = theta, 0.0
        return True

    return gathered(done, 6, lambda s: (s["theta"], math.copysign(1.0, s["theta"])), volume=False)


@bars("open high low close length direction", OHLC)
def RunBars(run_length=3):
    """Closes when a run of equal signs, which flat closes extend, reaches the length."""
    positive(run_length)
    prev, sign, n = None, 0, 0

    def done(s, r):
        nonlocal prev, sign, n
        if prev is not None:
            d = (r[3] > prev) - (r[3] < prev)
            if d == 0 or d == sign:
                n += sign != 0
            else:
                sign, n = d, 1
        prev = r[3]
        if not sign or n < run_length:
            return False
        s["run"], sign, n = (float(n), float(sign)), 0, 0
        return True

    return gathered(done, 6, lambda s: s["run"], volume=False)


@bars("open close direction")
def ThreeLineBreakBars(lines=3):
    """A new line beyond the last close, or against it beyond all of the last lines."""
    positive(lines)
    recent, seed = [], None

    def step(close):
        nonlocal seed
        if not recent:
            if seed is None:
                seed = close
                return []
            if close == seed:
                return []
            line = (seed, close, 1.0 if close > seed else -1.0)
        else:
            o, c, d = recent[-1]
            edge = [z for a, b, _ in recent for z in (a, b)]
            if (close - c) * d > 0:
                line = (c, close, d)
            elif close < min(edge) if d > 0 else close > max(edge):
                line = (c, close, -d)
            else:
                return []
        recent.append(line)
        del recent[:-lines]
        return [line]

    return step


@bars("price bid_volume ask_volume", ("price", "size", "side"))
def Footprint(tick_size=1.0):
    """After every trade, the traded volume by price bucket so far, sellers and buyers as aggressors; grows until the series ends."""
    positive(tick_size)
    seen: dict[float, list[float]] = {}

    def step(price, size, side):
        z = seen.setdefault(math.floor(price / tick_size) * tick_size, [0.0, 0.0])
        z[side > 0] += size
        return [(p, *seen[p]) for p in sorted(seen)]

    return step
