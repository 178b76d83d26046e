"""Swing-based operators: chart and harmonic patterns, Fibonacci levels, pitchfork, waves; and derived charts."""

import math

from ..plans.expr import *  # noqa: F403
from .catalog import family
from .common import c, h, l, o, v

NAN = float("nan")
SWING, LEVEL = 0.05, 0.03


class Swings:
    """Pivots (price, +1 high or -1 low, bar) of a reversal by ``SWING``; a bar that extends the swing doesn't reverse it."""

    def __init__(self, keep):
        self.keep, self.pivots, self.bar, self.way, self.at = keep, [], -1, 1, None

    def step(self, hi, lo):
        self.bar += 1
        far, near = (hi, lo) if self.way > 0 else (lo, hi)
        if self.at is None or (far - self.at[0]) * self.way > 0:
            self.at = (far, self.bar)
            return False
        limit = self.at[0] * (1 - SWING * self.way)
        if (near - limit) * self.way > 0:
            return False
        self.pivots.append((self.at[0], self.way, self.at[1]))
        del self.pivots[: -self.keep]
        self.way, self.at = -self.way, (near, self.bar)
        return True


def same(a, b, tol=LEVEL): return abs(a - b) <= tol * max(abs(a), abs(b), 2.2250738585072014e-308)


def on_pivots(need, rule, keep=None, tag=()):
    """0 on bars without a new pivot, else what ``rule`` says of the last pivots; missing until ``need`` are there."""

    def make():
        s = Swings(keep or need)

        def step(hi, lo):
            new = s.step(hi, lo)
            if len(s.pivots) < need:
                return None
            return float(rule(s.pivots[-need:])) if new else 0.0

        return step

    return scan(make, h, l, tag=("pivots", rule.__qualname__, tag))


def legs(p):
    """Older and newer high, older and newer low of four pivots."""
    (a, b), (x, y) = (p[0][0], p[2][0]), (p[1][0], p[3][0])
    return (x, y, a, b) if p[3][1] > 0 else (a, b, x, y)


op = family("Chart Patterns", "candle")


@op()
def DoubleTopBottom():
    def rule(p): return -p[2][1] if same(p[0][0], p[2][0]) else 0
    return on_pivots(3, rule)


@op()
def TripleTopBottom():
    def rule(p): return -p[4][1] if same(p[0][0], p[2][0]) and same(p[2][0], p[4][0]) else 0
    return on_pivots(5, rule)


@op()
def HeadAndShoulders():
    def rule(p):
        a, n1, head, n2, b = (z[0] for z in p)
        way = p[4][1]
        ok = same(a, b) and same(n1, n2) and (head - a) * way > 0 and (head - b) * way > 0
        return -way if ok else 0

    return on_pivots(5, rule)


@op()
def Triangle():
    def rule(p):
        h0, h1, l0, l1 = legs(p)
        rising, falling = l1 > l0 * (1 + LEVEL), h1 < h0 * (1 - LEVEL)
        if same(h0, h1) and rising:
            return 1
        if falling and same(l0, l1):
            return -1
        return -p[3][1] if falling and rising else 0

    return on_pivots(4, rule)


@op()
def Wedge():
    def rule(p):
        h0, h1, l0, l1 = legs(p)
        a, b = h1 - h0, l1 - l0
        return -1 if a > 0 and b > a else 1 if b < 0 and a < b else 0

    return on_pivots(4, rule)


@op()
def FlagPennant():
    def rule(p):
        pole = abs(p[1][0] - p[0][0])
        return p[1][1] if pole > 0 and abs(p[2][0] - p[1][0]) < 0.5 * pole else 0

    return on_pivots(3, rule)


@op()
def RectangleRange():
    def rule(p):
        h0, h1, l0, l1 = legs(p)
        return -p[3][1] if same(h0, h1) and same(l0, l1) else 0

    return on_pivots(4, rule)


@op()
def CupAndHandle():
    def rule(p):
        a, low, b, handle = (z[0] for z in p)
        lo, hi = min(low, b), max(low, b)
        ok = same(a, b) and lo < handle < hi and (b - low) * -p[3][1] > 0
        return -p[3][1] if ok else 0

    return on_pivots(4, rule)


op = family("Harmonic Patterns", "candle")


def harmonic(**bounds):
    """Legs XA, AB, BC, CD, AD, XC whose ratios, named ``ab_xa`` and so on, lie in the bounds."""

    def rule(p):
        x, a, b, cc, d = (z[0] for z in p)
        size = {"xa": abs(a - x), "ab": abs(b - a), "bc": abs(cc - b), "cd": abs(d - cc), "ad": abs(d - a), "xc": abs(cc - x)}
        for k, (lo, hi) in bounds.items():
            m, n = k.split("_")
            if not size[n] or not lo <= size[m] / size[n] <= hi:
                return 0
        return -p[4][1]

    return on_pivots(5, rule, tag=tuple(sorted(bounds.items())))


@op()
def Abcd():
    def rule(p):
        ab, bc, cd = (abs(p[i + 1][0] - p[i][0]) for i in range(3))
        return -p[3][1] if 0.382 <= bc / ab <= 0.886 and 1.13 <= cd / bc <= 2.618 and same(ab, cd, 0.10) else 0

    return on_pivots(4, rule)


@op()
def Gartley(): return harmonic(ab_xa=(0.55, 0.70), bc_ab=(0.382, 0.886), cd_bc=(1.13, 1.618), ad_xa=(0.74, 0.84))
@op()
def Butterfly(): return harmonic(ab_xa=(0.74, 0.84), bc_ab=(0.382, 0.886), cd_bc=(1.618, 2.618), ad_xa=(1.27, 1.618))
@op()
def Bat(): return harmonic(ab_xa=(0.382, 0.50), bc_ab=(0.382, 0.886), cd_bc=(1.618, 2.618), ad_xa=(0.84, 0.93))
@op()
def Crab(): return harmonic(ab_xa=(0.382, 0.618), bc_ab=(0.382, 0.886), cd_bc=(2.24, 3.618), ad_xa=(1.55, 1.65))
@op()
def Shark(): return harmonic(ab_xa=(1.13, 1.618), bc_ab=(1.618, 2.24), cd_bc=(0.382, 0.886), ad_xa=(0.886, 1.13))
@op()
def Cypher(): return harmonic(ab_xa=(0.382, 0.618), xc_xa=(1.272, 1.414), cd_xc=(0.74, 0.83))


@op()
def ThreeDrives():
    def rule(p):
        z = [abs(p[i + 1][0] - p[i][0]) for i in range(6)]
        back, drive = z[::2], z[1::2]
        ok = all(1.13 <= d / b <= 1.75 for b, d in zip(back, drive, strict=True))
        ok = ok and same(drive[0], drive[1], 0.20) and same(drive[1], drive[2], 0.20)
        return -p[6][1] if ok and same(back[0], back[1], 0.30) and same(back[1], back[2], 0.30) else 0

    return on_pivots(7, rule)


op = family("Fibonacci", "candle")


def every_bar(need, keep, f, outs, tag):
    """f(pivots, current bar) on every bar once ``need`` pivots are there."""

    def make():
        s = Swings(keep)

        def step(hi, lo):
            s.step(hi, lo)
            return f(s.pivots, s.bar) if len(s.pivots) >= need else None

        return step

    return scan(make, h, l, outs=outs, tag=("fib", tag))


def level_names(ratios): return " ".join(f"level_{round(r * 1000)}" for r in ratios)


RETRACE = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
EXTEND = (1.272, 1.414, 1.618, 2.0, 2.618)


def on_leg(a, b, ratios): return tuple(b + r * (a - b) for r in ratios)


@op()
def FibRetracement(): return picks(every_bar(2, 2, lambda p, _: on_leg(p[-2][0], p[-1][0], RETRACE), 7, "retrace"), level_names(RETRACE))
@op()
def FibExtension(): return picks(every_bar(2, 2, lambda p, _: tuple(p[-2][0] + r * (p[-1][0] - p[-2][0]) for r in EXTEND), 5, "extend"), level_names(EXTEND))


@op()
def FibProjection():
    r = (0.618, 1.0, 1.618, 2.618)
    return picks(every_bar(3, 3, lambda p, _: tuple(p[2][0] + k * (p[1][0] - p[0][0]) for k in r), 4, "project"), level_names(r))


@op()
def AutoFib():
    def f(p, _):
        a, b = max(zip(p, p[1:]), key=lambda z: (abs(z[0][0] - z[1][0]), z[1][2]))  # noqa: B905
        return on_leg(a[0], b[0], RETRACE)

    return picks(every_bar(2, 6, f, 7, "auto"), level_names(RETRACE))


@op()
def GoldenPocket():
    def f(p, _):
        a, b = on_leg(p[-2][0], p[-1][0], (0.618, 0.65))
        return min(a, b), (a + b) / 2, max(a, b)

    return picks(every_bar(2, 2, f, 3, "pocket"), "low mid high")


@op()
def FibConfluence():
    def f(p, _):
        z = [k for a, b in zip(p, p[1:]) for k in on_leg(a[0], b[0], (0.382, 0.5, 0.618))]  # noqa: B905
        best = (0, 0.0)
        for k in z:
            near = [m for m in z if same(m, k)]
            if len(near) >= best[0]:
                best = (len(near), sum(near) / len(near))
        return best[1], float(best[0])

    return picks(every_bar(3, 6, f, 2, "confluence"), "price strength")


THIRDS = (0.382, 0.5, 0.618)


@op()
def FibFan():
    def f(p, bar):
        (a, _, i), (b, _, j) = p
        return tuple(a + r * (b - a) * (bar - i) / (j - i) for r in THIRDS)

    return picks(every_bar(2, 2, f, 3, "fan"), "fan_382 fan_500 fan_618")


@op()
def FibArcs():
    def f(p, bar):
        (a, _, i), (b, _, j) = p
        k = math.sqrt(max(0.0, 1 - ((bar - j) / (j - i)) ** 2))
        return tuple(b + (a - b) * r * k for r in THIRDS)

    return picks(every_bar(2, 2, f, 3, "arcs"), "arc_382 arc_500 arc_618")


@op()
def FibChannel():
    def f(p, bar):
        (a, _, i), (b, _, j), (d, _, k) = p
        s = (d - a) / (k - i)
        base, width = a + s * (bar - i), b - (a + s * (j - i))
        return base, *(base + r * width for r in (0.618, 1.0, 1.618))

    return picks(every_bar(3, 3, f, 4, "channel"), "base level_618 level_1000 level_1618")


@op()
def FibTimeZones():
    def f(p, bar):
        d, a, b, on = bar - p[-1][2], 1, 2, 0.0
        while a <= d:
            on = 1.0 if a == d else on
            a, b = b, a + b
        return on, float(a - d)

    return picks(every_bar(1, 2, f, 2, "zones"), "on_zone bars_to_next")


# ---- centred fractals of 2 k + 1 bars


def fractals(k, on_pivot, emit, outs, tag):
    def make():
        w, n, state = [], 0, {}

        def step(hi, lo):
            nonlocal n
            n += 1
            w.append((hi, lo))
            del w[: -(2 * k + 1)]
            if len(w) == 2 * k + 1:
                a, b = w[k]
                rest = w[:k] + w[k + 1 :]
                top, low = all(z[0] < a for z in rest), all(z[1] > b for z in rest)
                if top != low:
                    on_pivot(state, a if top else b, 1 if top else -1, n - 1 - k)
            return emit(state, n - 1)

        return step

    return scan(make, h, l, outs=outs, tag=(tag, k))


op = family("Pivots & S/R", "candle")


@op()
def AndrewsPitchfork(strength=2):
    def add(s, price, way, bar):
        p = s.setdefault("p", [])
        if p and p[-1][1] == way:
            if (price - p[-1][0]) * way > 0:
                p[-1] = (price, way, bar)
        else:
            p.append((price, way, bar))
            del p[:-3]

    def emit(s, bar):
        if len(s.get("p", ())) < 3:
            return None
        (a, _, i), (b, _, j), (d, _, k) = s["p"]
        mid, at = (b + d) / 2, (j + k) / 2
        m = (mid - a) / (at - i)
        lines = [z + m * (bar - t) for z, t in ((b, j), (d, k))]
        return a + m * (bar - i), max(lines), min(lines)

    return picks(fractals(strength, add, emit, 3, "fork"), "median upper lower")


op = family("DeMark", "candle")


@op()
def TdDWave(strength=2):
    def add(s, price, way, bar):
        if s.get("way") == way:
            s["price"] = max(s["price"], price) if way > 0 else min(s["price"], price)
        else:
            s["n"] = s.get("n", 0) % 8 + 1
            s["way"], s["price"] = way, price

    return fractals(strength, add, lambda s, bar: float(s["n"]) if s.get("n") else None, 1, "wave")


op = family("Ichimoku & Charts", "candle")


@op()
def Ichimoku(tenkan_period=9, kijun_period=26, senkou_b_period=52, displacement=26):
    m = lambda n: (rmax(h, n) + rmin(l, n)) / 2.0
    t, k = m(tenkan_period), m(kijun_period)
    d = displacement - 1
    return {"tenkan": t, "kijun": k, "senkou_a": lag((t + k) / 2.0, d), "senkou_b": lag(m(senkou_b_period), d), "chikou": lag(c, d)}


def heikin(o, h, l, c):  # noqa: E741
    close = (o + h + l + c) / 4.0

    def make():
        y = p = None

        def step(a, z, k):
            nonlocal y, p
            y = (a + z) / 2 if y is None else (y + p) / 2
            p = k
            return y

        return step

    start = scan(make, o, c, close, tag="heikin")
    return {"open": start, "high": mx(h, start, close), "low": mn(l, start, close), "close": close + 0.0 * start}


@op()
def HeikinAshi(): return heikin(o, h, l, c)


@op()
def HeikinAshiOscillator(period=5):
    k = heikin(o, h, l, c)
    return ema(k["close"] - k["open"], period)


@op()
def ThreeLineBreak(lines=3):
    def make():
        z, way = [], 0

        def step(a):
            nonlocal way
            if not z:
                z.append(a)
                return None
            new = (a > z[-1] or a < min(z)) if way >= 0 else (a < z[-1] or a > max(z))
            if new:
                way = 1 if a > z[-1] else -1
                z.append(a)
                del z[:-lines]
            return float(way) if way else None

        return step

    return scan(make, c, tag=lines)


@op()
def SmoothedHeikinAshi(period=5): return heikin(*(ema(z, period) for z in (o, h, l, c)))
@op()
def Equivolume(period=20): return {"height": h - l + 0.0 * ravg(v, period), "width": div(v, ravg(v, period), 0.0)}
@op()
def CandleVolume(period=20): return {"body": c - o + 0.0 * ravg(v, period), "width": div(v, ravg(v, period), 0.0)}
