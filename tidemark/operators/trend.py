"""Trend and directional operators, and price oscillators."""

import math

from ..plans.expr import *  # noqa: F403
from .averages import alligator
from .catalog import family
from .common import c, h, l, o, true_range, typical, x
from .momentum import awesome, endpoint

op = family("Trend & Directional", "x")


def macd_of(fast, slow, signal, kind=ema):
    m = kind(x, fast) - kind(x, slow)
    s = kind(m, signal)
    return {"macd": m + 0.0 * s, "signal": s, "histogram": m - s}


@op()
def MacdIndicator(fast=12, slow=26, signal=9): return macd_of(fast, slow, signal)
@op()
def MacdFix(signal=9): return macd_of(12, 26, signal)


def average(kind: int):
    """0..5: simple, exponential, linearly weighted, double, triple, triangular."""

    def dema(x, n):
        e = ema(x, n)
        return 2.0 * e - ema(e, n)

    def tema(x, n):
        a = ema(x, n)
        b = ema(a, n)
        return 3.0 * a - 3.0 * b + ema(b, n)

    def trima(x, n):
        a = (n + 1) // 2
        return ravg(ravg(x, a), n + 1 - a)

    return [ravg, ema, wma, dema, tema, trima][kind]


@op()
def MacdExt(fast=12, fast_type=0, slow=26, slow_type=0, signal=9, signal_type=0):
    m = average(fast_type)(x, fast) - average(slow_type)(x, slow)
    s = average(signal_type)(m, signal)
    return {"macd": m + 0.0 * s, "signal": s, "histogram": m - s}


def moves():
    up, down = h - lag(h), lag(l) - l
    return where((up > down) & (up > 0.0), up, 0.0), where((down > up) & (down > 0.0), down, 0.0), mx(h - l, abs(h - lag(c)), abs(l - lag(c)))


def directional(n):
    p, m, t = (wsum(z, n) for z in moves())
    pdi, mdi = div(100.0 * p, t, 0.0), div(100.0 * m, t, 0.0)
    return pdi, mdi, div(100.0 * abs(pdi - mdi), pdi + mdi, 0.0)


@op("candle")
def Adx(period=14):
    p, m, d = directional(period)
    a = rma(d, period)
    return {"plus_di": p + 0.0 * a, "minus_di": m + 0.0 * a, "adx": a}


@op("candle")
def Adxr(period=14):
    a = rma(directional(period)[2], period)
    return (a + lag(a, period - 1)) / 2.0


def newest_extreme(w):
    return float(len(w) - 1 - (w[::-1].argmax()))


def aroon(n):
    up, down = window(newest_extreme, n + 1, h), window(newest_extreme, n + 1, -l)
    return 100.0 * up / float(n), 100.0 * down / float(n)


@op("candle")
def Aroon(period=14): return dict(zip(("up", "down"), aroon(period), strict=True))


@op()
def Trix(period=30):
    e = ema(ema(ema(x, period), period), period)
    return div(100.0 * (e - lag(e)), lag(e), 0.0)


@op("candle")
def AroonOscillator(period=14):
    u, d = aroon(period)
    return u - d


@op("candle")
def Vortex(period=14):
    t = rsum(moves()[2], period)
    return {"plus": div(rsum(abs(h - lag(l)), period), t, 0.0), "minus": div(rsum(abs(l - lag(h)), period), t, 0.0)}


@op("candle")
def Rwi(period=14):
    def of(hi, lo, tr):
        best = [0.0, 0.0]
        for k in range(2, len(hi) + 1):
            if (a := tr[1 - k :].mean() * math.sqrt(k)) != 0:
                best = [max(best[0], (hi[-1] - lo[-k]) / a), max(best[1], (hi[-k] - lo[-1]) / a)]
        return best

    return picks(window(of, period, h, l, true_range(), outs=2), "high low")


@op()
def Tii(sma_period=60, dev_period=30):
    d = x - ravg(x, sma_period)
    p, n = rsum(mx(d, 0.0), dev_period), rsum(mx(-d, 0.0), dev_period)
    return div(100.0 * p, p + n, 50.0)


@op("candle")
def WaveTrend(channel_period=10, average_period=21, signal_period=4):
    e = ema(typical, channel_period)
    d = ema(abs(typical - e), channel_period)
    a = ema(div(typical - e, 0.015 * d, 0.0), average_period)
    s = ravg(a, signal_period)
    return {"wt1": a + 0.0 * s, "wt2": s}


@op("candle")
def MassIndex(ema_period=9, sum_period=25):
    e = ema(h - l, ema_period)
    return rsum(div(e, ema(e, ema_period), 1.0), sum_period)


@op("candle")
def ChoppinessIndex(period=14):
    s = rmax(h, period) - rmin(l, period)
    r = fn("log10", div(rsum(true_range(), period), s, 1.0)) / math.log10(max(period, 2)) * 100.0
    return where(eq(s, 0.0), 100.0, r)


@op()
def VerticalHorizontalFilter(period=28):
    d = rsum(abs(x - lag(x)), period)
    return div(rmax(x, period) - rmin(x, period), d, 0.0)


@op("candle")
def PlusDm(period=14): return wsum(moves()[0], period)
@op("candle")
def MinusDm(period=14): return wsum(moves()[1], period)
@op("candle")
def PlusDi(period=14): return directional(period)[0]
@op("candle")
def MinusDi(period=14): return directional(period)[1]
@op("candle")
def Dx(period=14): return directional(period)[2]
@op()
def TrendLabel(period=10): return sign(slope(x, period))


@op("candle")
def TtmTrend(period=6): return where(c > ravg((h + l) / 2.0, period), 1.0, -1.0)


def r_squared(value, n, flat=0.0):
    return div(slope(value, n) ** 2.0 * ((n * n - 1) / 12.0), rvar(value, n), flat)


@op()
def TrendStrengthIndex(period=14): return sign(slope(x, period)) * r_squared(x, period)
@op("candle")
def Qstick(period=10): return ravg(c - o, period)


@op()
def PolarizedFractalEfficiency(period=10, smoothing=5):
    d = x - lag(x, period)
    path = rsum(sqrt((x - lag(x)) ** 2.0 + 1.0), period)
    return ema(sign(d) * 100.0 * sqrt(d**2.0 + float(period * period)) / path, smoothing)


@op()
def WavePm(length=14, smoothing=5):
    m = x - lag(x, length)
    e = ema(m**2.0, length)
    return ema(where(e > 0.0, 100.0 * (1.0 - exp(-1.0 * div(m**2.0, 2.0 * e))), 0.0), smoothing)


@op("candle")
def GatorOscillator(jaw_period=13, teeth_period=8, lips_period=5):
    a = alligator(jaw_period, teeth_period, lips_period)
    return {"upper": abs(a["jaw"] - a["teeth"]), "lower": -abs(a["teeth"] - a["lips"])}


@op("candle")
def KasePermissionStochastic(length=9, smooth=3):
    a, b = rmax(h, length), rmin(l, length)
    f = ema(div(100.0 * (c - b), a - b, 50.0), smooth)
    s = ema(f, smooth)
    return {"fast": f + 0.0 * s, "slow": s}


op = family("Price Oscillators", "x")


def ppo(fast, slow):
    s = ema(x, slow)
    return div(100.0 * (ema(x, fast) - s), s, 0.0)


@op()
def Ppo(fast=12, slow=26): return ppo(fast, slow)
@op()
def Dpo(period=20): return lag(x, period // 2 + 1) - ravg(x, period)


@op()
def Coppock(roc_long_period=14, roc_short_period=11, wma_period=10):
    r = lambda n: div(100.0 * (x - lag(x, n)), lag(x, n), 0.0)
    return wma(r(roc_long_period) + r(roc_short_period), wma_period)


@op("candle")
def AcceleratorOscillator(ao_fast=5, ao_slow=34, signal_period=5):
    a = awesome(ao_fast, ao_slow)
    return a - ravg(a, signal_period)


@op("candle")
def BalanceOfPower(): return div(c - o, h - l, 0.0)
@op()
def Apo(fast=12, slow=26): return ema(x, fast) - ema(x, slow)


@op("candle")
def AwesomeOscillatorHistogram(fast=5, slow=34, lookback=1):
    a = awesome(fast, slow)
    return a - lag(a, lookback)


@op()
def Cfo(period=14): return fill(only(ne(x, 0.0), div(100.0 * (x - endpoint(x, period)), x)))


def zlema(value, n):
    return ema(2.0 * value - lag(value, (n - 1) // 2), n)


@op()
def ZeroLagMacd(fast=12, slow=26, signal=9): return macd_of(fast, slow, signal, zlema)


@op()
def ElderImpulse(ema_period=13, macd_fast=12, macd_slow=26, macd_signal=9):
    e, g = ema(x, ema_period), macd_of(macd_fast, macd_slow, macd_signal)["histogram"]
    de, dg = e - lag(e), g - lag(g)
    return cases((de > 0.0) & (dg > 0.0), 1.0, (de < 0.0) & (dg < 0.0), -1.0, 0.0)


@op()
def Stc(fast=23, slow=50, schaff_period=10, factor=0.5):
    m = ema(x, fast) - ema(x, slow)

    def k(value):
        a, b = rmax(value, schaff_period), rmin(value, schaff_period)
        return div(100.0 * (value - b), a - b, 0.0)

    f = ema(k(m), alpha=factor)
    return clamp(ema(k(f), alpha=factor), 0.0, 100.0)


@op()
def TsfOscillator(period=14):
    f = ravg(x, period) + slope(x, period) * ((period + 1) / 2.0)
    return fill(only(ne(x, 0.0), div(100.0 * (x - f), x)))


@op()
def MacdHistogram(fast=12, slow=26, signal=9): return macd_of(fast, slow, signal)["histogram"]


@op()
def PpoHistogram(fast=12, slow=26, signal=9):
    p = ppo(fast, slow)
    return p - ema(p, signal)


