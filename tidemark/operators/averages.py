"""Moving averages."""

import math

from ..plans.expr import *  # noqa: F403
from ..plans.expr import NAN
from .catalog import family
from .common import c, h, l, v, x

op = family("Moving Averages", "x")


@op()
def Sma(period=14): return ravg(x, period)
@op()
def Ema(period=14): return ema(x, period)
@op()
def Wma(period=14): return wma(x, period)


@op()
def Dema(period=14):
    e = ema(x, period)
    return 2.0 * e - ema(e, period)


@op()
def Tema(period=14):
    a = ema(x, period)
    b = ema(a, period)
    return 3.0 * a - 3.0 * b + ema(b, period)


@op()
def Hma(period=14):
    return wma(2.0 * wma(x, max(1, period // 2)) - wma(x, period), max(1, round(math.sqrt(period))))


def variable_ema(value, alpha, seed=None):
    """y = alpha x + (1 - alpha) y, from ``seed`` (or the value) at the first row that has all."""

    def make():
        y = None

        def step(a, b, s):
            nonlocal y
            y = s if y is None else y
            y = y + b * (a - y)
            return y

        return step

    return scan(make, value, alpha, value if seed is None else seed, tag="variable")


def efficiency(value, n):
    """|x - x[n]| / sum of |differences|, 0 when nothing moves."""
    return div(abs(value - lag(value, n)), rsum(abs(value - lag(value)), n), 0.0)


@op()
def Kama(er_period=10, fast=2, slow=30):
    f, s = 2.0 / (fast + 1), 2.0 / (slow + 1)
    sc = (efficiency(x, er_period) * (f - s) + s) ** 2.0
    return variable_ema(x, sc, lag(x, er_period))


@op()
def Smma(period=14): return rma(x, period)


@op()
def Trima(period=14):
    a = (period + 1) // 2
    return ravg(ravg(x, a), period + 1 - a)


@op()
def Zlema(period=14):
    k = (period - 1) // 2
    return ema(2.0 * x - lag(x, k), period)


@op()
def T3(period=14, v=0.7):
    e = [x]
    for _ in range(6):
        e.append(ema(e[-1], period))
    return -(v**3) * e[6] + (3 * v**2 + 3 * v**3) * e[5] + (-6 * v**2 - 3 * v - 3 * v**3) * e[4] + (1 + 3 * v + v**3 + 3 * v**2) * e[3]


@op("candle")
def Vwma(period=14):
    s = rsum(v, period)
    return where(s > 0.0, fn("div", rsum(c * v, period), s), ravg(c, period))


@op()
def Alma(period=9, offset=0.85, sigma=6.0):
    m, s = offset * (period - 1), period / sigma
    w = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(period)]
    return weighted(x, [a / sum(w) for a in w])


@op()
def McGinleyDynamic(period=10):
    def make():
        k, s = 0, 0.0

        def step(a):
            nonlocal k, s
            if k < period:
                k += 1
                s += a
                if k < period:
                    return None
                s /= period
                return s
            if s > 0 and a > 0:
                s += (a - s) / (0.6 * period * (a / s) ** 4)
            return s

        return step

    return scan(make, x, tag=period)


@op()
def Frama(period=16):
    half = period // 2
    n1 = (rmax(x, half) - rmin(x, half)) / float(half)
    n2 = lag(rmax(x, half) - rmin(x, half), half) / float(half)
    n3 = (rmax(x, period) - rmin(x, period)) / float(period)
    d = (ln(n1 + n2) - ln(n3)) / math.log(2)
    alpha = where((n1 > 0.0) & (n2 > 0.0) & (n3 > 0.0), clamp(exp(-4.6 * (fn("coalesce", d, 1.0) - 1.0)), 0.01, 1.0), 0.01)
    return variable_ema(x, alpha)


def cmo(value, n):
    d = value - lag(value)
    g, s = rsum(mx(d, 0.0), n), rsum(mx(-d, 0.0), n)
    return div(100.0 * (g - s), g + s, 0.0)


@op()
def Vidya(period=14, cmo_period=9):
    return variable_ema(x, abs(cmo(x, cmo_period)) / 100.0 * (2.0 / (period + 1)))


@op()
def Jma(period=14, phase=0.0, power=2):
    ratio = 0.5 if phase < -100 else 2.5 if phase > 100 else phase / 100 + 1.5
    beta = 0.45 * (period - 1) / (0.45 * (period - 1) + 2)
    alpha = beta**power

    def make():
        e0 = e1 = e2 = 0.0
        j = None

        def step(a):
            nonlocal e0, e1, e2, j
            if j is None:
                e0, j = a, a
                return a
            e0 = (1 - alpha) * a + alpha * e0
            e1 = (a - e0) * (1 - beta) + beta * e1
            e2 = (e0 + ratio * e1 - j) * (1 - alpha) ** 2 + alpha**2 * e2
            j += e2
            return j

        return step

    return scan(make, x, tag=(period, phase, power))


def alligator(jaw, teeth, lips):
    m = (h + l) / 2.0
    a, b, d = rma(m, jaw), rma(m, teeth), rma(m, lips)
    ready = 0.0 * (a + b + d)
    return {"jaw": a + ready, "teeth": b + ready, "lips": d + ready}


@op("candle")
def Alligator(jaw_period=13, teeth_period=8, lips_period=5): return alligator(jaw_period, teeth_period, lips_period)


@op("candle")
def Evwma(period=20):
    s = rsum(v, period)

    def make():
        y = None

        def step(price, vol, total):
            nonlocal y
            if total > 0:
                y = price if y is None else ((total - vol) * y + vol * price) / total
            elif y is None:
                y = price
            return y

        return step

    return scan(make, c, v, s, tag=period)


@op()
def SineWeightedMa(period=14):
    w = [math.sin(math.pi * (i + 1) / (period + 1)) for i in range(period)]
    return weighted(x, [a / sum(w) for a in w])


@op()
def GeometricMa(period=14): return exp(ravg(ln(x), period))


@op()
def Ehma(period=9):
    return ema(2.0 * ema(x, max(1, period // 2)) - ema(x, period), max(1, round(math.sqrt(period))))


@op()
def MedianMa(period=14): return rq(x, period, 0.5)


@op()
def AdaptiveLaguerreFilter(period=20):
    def make():
        from collections import deque

        errors, stage, out = deque(maxlen=period), (0.0,) * 4, None

        def step(a):
            nonlocal stage, out
            errors.append(0.0 if out is None else abs(a - out))
            lo, hi = min(errors), max(errors)
            ranked = sorted((e - lo) / (hi - lo) if hi > lo else 0.0 for e in errors)
            n = len(ranked)
            g = ranked[n // 2] if n % 2 else (ranked[n // 2 - 1] + ranked[n // 2]) / 2
            l0 = (1 - g) * a + g * stage[0]
            l1 = -g * l0 + stage[0] + g * stage[1]
            l2 = -g * l1 + stage[1] + g * stage[2]
            l3 = -g * l2 + stage[2] + g * stage[3]
            stage, out = (l0, l1, l2, l3), (l0 + 2 * l1 + 2 * l2 + l3) / 6
            return out if n == period else None

        return step

    return scan(make, x, tag=period)


@op()
def GeneralizedDema(period=14, v=0.7):
    e = ema(x, period)
    return (1 + v) * e - v * ema(e, period)


@op()
def HoltWinters(alpha=0.2, beta=0.1):
    def make():
        level = trend = None

        def step(a):
            nonlocal level, trend
            if level is None:
                level = a
                return None
            if trend is None:
                level, trend = a, a - level
                return level + trend
            old = level
            level = alpha * a + (1 - alpha) * (level + trend)
            trend = beta * (level - old) + (1 - beta) * trend
            return level + trend

        return step

    return scan(make, x, tag=(alpha, beta))
