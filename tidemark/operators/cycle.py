"""Cycle operators and linear filters."""

import math

import numpy as np

from ..plans.expr import *  # noqa: F403
from .averages import efficiency, variable_ema
from .catalog import family
from .common import typical, x

op = family("Ehlers / Cycle", "x")
TINY = np.finfo(float).eps


class Hilbert:
    """Quadrature filter of a 4-bar weighted price with its period estimate; step gives (i1, q1, smooth) once ready."""

    #: Coefficients of the transform and of the period's amplitude correction (fixed values).
    A, B, SLOPE, BASE = 0.0962, 0.5769, 0.075, 0.54

    def __init__(self, need=7, homodyne=True):
        self.need, self.homodyne = need, homodyne
        self.price, self.det, self.q1, self.i1 = ([] for _ in range(4))
        self.period = self.smooth_period = self.i2 = self.q2 = self.re = self.im = 0.0
        self.count, self.smooth = 0, None

    @staticmethod
    def push(buf, a, n=7):
        buf.insert(0, a)
        del buf[n:]

    def filter(self, b, gain, first=None):
        a = b[0] if first is None else first
        return (self.A * a + self.B * b[2] - self.B * b[4] - self.A * b[6]) * gain

    def step(self, a, period=None):
        self.count += 1
        self.push(self.price, a)
        p = self.price
        if len(p) < 4:
            return None
        self.smooth = (4 * p[0] + 3 * p[1] + 2 * p[2] + p[3]) / 10
        if len(p) < 7:
            return None
        gain = self.SLOPE * min(max(self.period if period is None else period, 6.0), 50.0) + self.BASE
        self.push(self.det, self.filter(p, gain, self.smooth))
        if len(self.det) < 7:
            return None
        q1, i1 = self.filter(self.det, gain), self.det[3]
        if not self.homodyne:
            return i1, q1
        self.push(self.q1, q1)
        self.push(self.i1, i1)
        if len(self.q1) < 7:
            return None
        i2 = 0.2 * (i1 - self.filter(self.q1, gain)) + 0.8 * self.i2
        q2 = 0.2 * (q1 + self.filter(self.i1, gain)) + 0.8 * self.q2
        re = 0.2 * (i2 * self.i2 + q2 * self.q2) + 0.8 * self.re
        im = 0.2 * (i2 * self.q2 - q2 * self.i2) + 0.8 * self.im
        self.i2, self.q2, self.re, self.im = i2, q2, re, im
        new = 2 * math.pi / math.atan2(im, re) if abs(im) > TINY and abs(re) > TINY else self.period
        new = min(max(max(min(new, 1.5 * self.period), 0.67 * self.period), 6.0), 50.0)
        self.period = 0.2 * new + 0.8 * self.period
        self.smooth_period = 0.33 * self.period + 0.67 * self.smooth_period
        return i1, q1


def mama(fast_limit, slow_limit):
    def make():
        hb, phase, m, f = Hilbert(), 0.0, None, None

        def step(a):
            nonlocal phase, m, f
            got = hb.step(a)
            if got is None:
                if hb.smooth is not None and len(hb.price) < 7:
                    m = f = hb.smooth
                return None
            i1, q1 = got
            p = math.degrees(math.atan(q1 / i1)) if abs(i1) > TINY else phase
            d, phase = max(phase - p, 1.0), p
            k = min(max(fast_limit / d, slow_limit), fast_limit)
            m = k * a + (1 - k) * m
            f = 0.5 * k * m + (1 - 0.5 * k) * f
            return (m, f) if hb.count >= 33 else None

        return step

    return scan(make, x, outs=2, tag=("mama", fast_limit, slow_limit))


@op()
def Mama(fast_limit=0.5, slow_limit=0.05): return picks(mama(fast_limit, slow_limit), "mama fama")
@op()
def Fama(fast_limit=0.5, slow_limit=0.05): return pick(mama(fast_limit, slow_limit), 1)


@op()
def FisherTransform(period=10):
    a, b = rmax(x, period), rmin(x, period)
    raw = div(2.0 * (x - b), a - b, 1.0) - 1.0

    def make():
        s = 0.0

        def step(r):
            nonlocal s
            s = 0.33 * r + 0.67 * s
            k = min(max(s, -0.999), 0.999)
            return 0.5 * math.log((1 + k) / (1 - k))

        return step

    return scan(make, raw)


@op()
def InverseFisherTransform(scale=1.0): return fn("tanh", scale * x)


def super_smoother(value, n):
    g = math.sqrt(2) * math.pi / n
    c2, c3 = 2 * math.exp(-g) * math.cos(g), -math.exp(-2 * g)
    c1 = 1 - c2 - c3

    def make():
        p = y1 = y2 = None

        def step(a):
            nonlocal p, y1, y2
            y = a if y2 is None else c1 * (a + p) / 2 + c2 * y1 + c3 * y2
            p, y1, y2 = a, y, y1
            return y

        return step

    return scan(make, value, tag=("smoother", n))


@op()
def SuperSmoother(period=10): return super_smoother(x, period)


def dominant():
    def make():
        hb = Hilbert()

        def step(a):
            got = hb.step(a)
            return hb.smooth_period if got and hb.count >= 50 else None

        return step

    return scan(make, x, tag="dominant")


@op()
def HilbertDominantCycle(): return dominant()


def dc_phase(prices, smooth_period):
    n = int(smooth_period + 0.5)
    k = np.arange(min(n, len(prices)))
    w = np.array(prices[: len(k)])
    re, im = float((np.sin(2 * np.pi * k / n) * w).sum()), float((np.cos(2 * np.pi * k / n) * w).sum())
    ph = math.degrees(math.atan(re / im)) if abs(im) > 0 else (90.0 if re >= 0 else -90.0)
    ph += 90.0 + (360.0 / smooth_period if smooth_period else 0.0)
    if im < 0:
        ph += 180.0
    return ph - 360.0 if ph > 315.0 else ph


@op()
def HtDcPhase():
    def make():
        hb, prices = Hilbert(), []

        def step(a):
            got = hb.step(a)
            if len(hb.price) == 7:
                Hilbert.push(prices, hb.smooth, 50)
            return dc_phase(prices, hb.smooth_period) if got and hb.count >= 50 else None

        return step

    return scan(make, x)


@op()
def HtTrendMode():
    def make():
        hb, prices, means = Hilbert(), [], [0.0] * 3
        phase = sine = lead = days = 0.0

        def step(a):
            nonlocal phase, sine, lead, days
            got = hb.step(a)
            if len(hb.price) == 7:
                Hilbert.push(prices, hb.smooth, 50)
            if not got:
                return None
            period = hb.smooth_period
            now = dc_phase(prices, period)
            s, k = math.sin(math.radians(now)), math.sin(math.radians(now + 45))
            n = min(max(int(period + 0.5), 1), len(prices))
            mean = sum(prices[:n]) / n
            line = (4 * mean + 3 * means[0] + 2 * means[1] + means[2]) / 10
            Hilbert.push(means, mean, 3)
            crossed = (s > k and sine <= lead) or (s < k and sine >= lead)
            days = 1.0 if crossed else days + 1
            turn = now - phase
            cycle = crossed or days < 0.5 * period or (period and 0.67 * 360 / period < turn < 1.5 * 360 / period)
            if line and abs((hb.smooth - line) / line) >= 0.015:
                cycle = False
            phase, sine, lead = now, s, k
            return (0.0 if cycle else 1.0) if hb.count >= 50 else None

        return step

    return scan(make, x)


@op()
def HtPhasor():
    def make():
        hb = Hilbert()
        return lambda a: hb.step(a)

    return picks(scan(make, x, outs=2), "inphase quadrature")


@op()
def SineWave():
    def make():
        hb, cycle, phase = Hilbert(homodyne=False), Hilbert(), 0.0

        def step(a):
            nonlocal phase
            ok = cycle.step(a)
            got = hb.step(a, cycle.smooth_period if ok and cycle.count >= 50 else 15.0)
            if not got:
                return None
            i1, q1 = got
            phase = math.atan(q1 / i1) if abs(i1) > TINY else phase
            return math.sin(phase) if hb.count >= 50 else None

        return step

    return scan(make, x)


def two_pole(value, alpha, gain, tag):
    """gain (x - 2 x1 + x2) + 2 (1 - alpha) y1 - (1 - alpha)^2 y2, 0 for the first two values."""

    def make():
        p = [None, None]
        y1 = y2 = 0.0

        def step(a):
            nonlocal y1, y2
            y = 0.0 if p[1] is None else gain * (a - 2 * p[0] + p[1]) + 2 * (1 - alpha) * y1 - (1 - alpha) ** 2 * y2
            p[:] = [a, p[0]]
            y1, y2 = y, y1
            return y

        return step

    return scan(make, value, tag=tag)


def high_pass(value, n):
    a = 0.707 * 2 * math.pi / n
    k = (math.cos(a) + math.sin(a) - 1) / math.cos(a)
    return two_pole(value, k, (1 - k / 2) ** 2, ("high", n))


@op()
def HighpassFilter(period=48): return high_pass(x, period)
@op()
def Decycler(period=60): return x - high_pass(x, period)
@op()
def DecyclerOscillator(fast=10, slow=20): return high_pass(x, slow) - high_pass(x, fast)


def roofing(value, low, high):
    a = 2 * math.pi / high
    k = (math.cos(a) + math.sin(a) - 1) / math.cos(a)

    def make():
        p, y = None, 0.0

        def step(z):
            nonlocal p, y
            y = 0.0 if p is None else (1 - k / 2) * (z - p) + (1 - k) * y
            p = z
            return y

        return step

    return super_smoother(scan(make, value, tag=("roof", high)), low)


@op()
def RoofingFilter(lp_period=10, hp_period=48): return roofing(x, lp_period, hp_period)


@op()
def CenterOfGravity(period=10):
    return div(-weighted(x, [float(k) for k in range(period, 0, -1)]), rsum(x, period), 0.0) + where(eq(rsum(x, period), 0.0), 0.0, (period + 1) / 2.0)


@op()
def CyberneticCycle(period=14):
    k = 2 / (period + 1)

    def make():
        xs, ss, cs = [], [], []

        def step(a):
            Hilbert.push(xs, a, 4)
            s = (xs[0] + 2 * xs[1] + 2 * xs[2] + xs[3]) / 6 if len(xs) == 4 else a
            Hilbert.push(ss, s, 3)
            if len(ss) == 3 and len(cs) >= 2:
                y = (1 - k / 2) ** 2 * (ss[0] - 2 * ss[1] + ss[2]) + 2 * (1 - k) * cs[0] - (1 - k) ** 2 * cs[1]
            else:
                z = [xs[i] if i < len(xs) else a for i in range(3)]
                y = (z[0] - 2 * z[1] + z[2]) / 4
            Hilbert.push(cs, y, 3)
            return y

        return step

    return scan(make, x, tag=period)


@op()
def AdaptiveCycle(): return clamp(fn("round", 0.5 * dominant()), 3.0, 25.0)


def band_pass(value, beta, alpha, tag):
    def make():
        p = [None, None]
        y1 = y2 = 0.0

        def step(a):
            nonlocal y1, y2
            y = 0.0 if p[1] is None else 0.5 * (1 - alpha) * (a - p[1]) + beta * (1 + alpha) * y1 - alpha * y2
            p[:] = [a, p[0]]
            y1, y2 = y, y1
            return y

        return step

    return scan(make, value, tag=tag)


@op()
def BandpassFilter(period=20, bandwidth=0.3):
    g = 1 / math.cos(4 * math.pi * bandwidth / period)
    return band_pass(x, math.cos(2 * math.pi / period), g - math.sqrt(g * g - 1), ("band", period, bandwidth))


@op()
def EmpiricalModeDecomposition(period=20, fraction=0.5):
    g = 1 / math.cos(0.5 * math.pi / period)
    bp = band_pass(x, math.cos(2 * math.pi / period), g - math.sqrt(g * g - 1), ("emd", period))
    n, m = max(1, round(period * fraction)), max(period, 2)
    mean = (super_smoother(rmax(bp, n), m) + super_smoother(rmin(bp, n), m)) / 2.0
    return super_smoother(bp - mean, m)


@op()
def EhlersStochastic(period=20):
    f = roofing(x, 10, 48)
    a, b = rmax(f, period), rmin(f, period)
    raw = where(a > b, div(2.0 * (f - b), a - b) - 1.0, 0.0)
    return fn("coalesce", (raw + lag(raw)) / 2.0, raw)


@op()
def InstantaneousTrendline(period=14):
    k = 2 / (period + 1)

    def make():
        xs, ys, n = [], [], 0

        def step(a):
            nonlocal n
            n += 1
            Hilbert.push(xs, a, 3)
            if n >= 7:
                y = (k - k * k / 4) * xs[0] + 0.5 * k * k * xs[1] - (k - 0.75 * k * k) * xs[2] + 2 * (1 - k) * ys[0] - (1 - k) ** 2 * ys[1]
            else:
                y = (xs[0] + 2 * (xs[1] if len(xs) > 1 else a) + (xs[2] if len(xs) > 2 else a)) / 4
            Hilbert.push(ys, y, 2)
            return y

        return step

    return scan(make, x, tag=period)


def flex(period, tilted):
    f = super_smoother(x, period)
    steps = sum(range(1, period + 1)) / period
    s = f - lag(ravg(f, period))
    if tilted:
        s = s + (lag(f, period) - f) / float(period) * steps

    def make():
        ms = 0.0

        def step(a):
            nonlocal ms
            ms = 0.04 * a * a + 0.96 * ms
            return a / math.sqrt(ms) if ms > 0 else 0.0

        return step

    return scan(make, s, tag="flex")


@op()
def Reflex(period=20): return flex(period, True)
@op()
def Trendflex(period=20): return flex(period, False)


@op()
def CorrelationTrendIndicator(period=20):
    s = rstd(x, period)
    return clamp(div(slope(x, period) * math.sqrt((period * period - 1) / 12), s, 0.0), -1.0, 1.0)


FAST, SLOW = 2 / 3, 2 / 31


@op()
def AdaptiveRsi(period=14):
    d = x - lag(x)
    sc = (efficiency(x, period) * (FAST - SLOW) + SLOW) ** 2.0
    g, s = mx(d, 0.0), mx(-d, 0.0)
    a, b = variable_seeded(g, sc, period), variable_seeded(s, sc, period)
    return div(100.0 * a, a + b, 50.0)


def variable_seeded(value, alpha, n):
    """Variable EMA that starts as the mean of the first n values."""

    def make():
        y = None

        def step(a, k, m):
            nonlocal y
            y = m if y is None else y + k * (a - y)
            return y

        return step

    return scan(make, value, alpha, ravg(value, n), tag="seeded")


@op()
def UniversalOscillator(period=20):
    f = super_smoother((x - lag(x, 2)) / 2.0, period)

    def make():
        peak = 0.0

        def step(a):
            nonlocal peak
            peak = max(abs(a), 0.991 * peak)
            return min(1.0, max(-1.0, a / peak)) if peak > 0 else 0.0

        return step

    return scan(make, f)


@op("candle")
def AdaptiveCci(period=20):
    er = div(abs(typical - lag(typical, period - 1)), rsum(abs(typical - lag(typical)), period - 1), 0.0)
    m = variable_seeded(typical, (er * (FAST - SLOW) + SLOW) ** 2.0, period)

    def mad(w, mean):
        return float(abs(w - mean[-1]).mean())

    d = window(mad, period, typical, fn("coalesce", m, 0.0))
    return div(typical - m, 0.015 * d, 0.0)


@op()
def EvenBetterSinewave(hp_period=40, ssf_length=10):
    w = 2 * math.pi / hp_period
    k = (1 - math.sin(w)) / math.cos(w)

    def make():
        p, y = None, 0.0

        def step(a):
            nonlocal p, y
            y = 0.0 if p is None else (1 + k) / 2 * (a - p) + k * y
            p = a
            return y

        return step

    f = super_smoother(scan(make, x, tag=("ebsw", hp_period)), ssf_length)
    return clamp(div(ravg(f, 3), sqrt(ravg(f**2.0, 3)), 0.0), -1.0, 1.0)


@op()
def AutocorrelationPeriodogram(min_period=10, max_period=48):
    m = 3
    ks = np.arange(min_period, max_period + 1)
    n = np.arange(m, max_period + 1)
    angle = 2 * np.pi * n[None, :] / ks[:, None]

    def make():
        buf, power, top = [], np.zeros(len(ks)), 0.0

        def step(a):
            nonlocal power, top
            buf.append(a)
            del buf[: -(max_period + m)]
            if len(buf) < max_period + m:
                return None
            w = np.array(buf)[::-1]
            corr = []
            for k in n:
                p, q = w[:m], w[k : k + m]
                p, q = p - p.mean(), q - q.mean()
                d = math.sqrt(float(p @ p) * float(q @ q))
                corr.append(float(p @ q) / d if d > 0 else 0.0)
            corr = np.array(corr)
            now = (np.cos(angle) @ corr) ** 2 + (np.sin(angle) @ corr) ** 2
            power = 0.2 * now + 0.8 * power
            top = max(0.995 * top, float(power.max()))
            rel = power / top if top > 0 else power * 0
            ok = rel >= 0.5
            s = float(rel[ok].sum())
            return min(max(float((ks * rel)[ok].sum()) / s, min_period), max_period) if s > 0 else float(min_period)

        return step

    return scan(make, roofing(x, min_period, max_period), tag=(min_period, max_period))
