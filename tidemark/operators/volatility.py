"""Volatility, bands and channels."""

import math

from ..plans.expr import *  # noqa: F403
from .catalog import family
from .common import atr, c, h, l, o, true_range, typical, v, x
from .momentum import endpoint

op = family("Volatility & Bands", "x")
log_return = ln(x) - ln(lag(x))


def bands(m, d):
    return {"upper": m + d, "middle": m + 0.0 * d, "lower": m - d}


@op("candle")
def Atr(period=14): return atr(period)


@op()
def BollingerBands(period=20, multiplier=2.0):
    s = rstd(x, period)
    return bands(ravg(x, period), multiplier * s) | {"stddev": s}


@op("candle")
def Keltner(ema_period=20, atr_period=10, multiplier=2.0): return bands(ema(typical, ema_period), multiplier * atr(atr_period))


@op("candle")
def Donchian(period=20):
    a, b = rmax(h, period), rmin(l, period)
    return {"upper": a, "middle": (a + b) / 2.0, "lower": b}


@op("candle")
def Natr(period=14): return div(100.0 * atr(period), c, 0.0)
@op()
def StdDev(period=20): return rstd(x, period)


@op()
def UlcerIndex(period=14):
    m = rmax(x, period)
    return sqrt(ravg(div(100.0 * (x - m), m, 0.0) ** 2.0, period))


@op()
def HistoricalVolatility(period=20, trading_periods=252): return rstds(log_return, period) * (math.sqrt(trading_periods) * 100.0)
@op()
def BollingerBandwidth(period=20, multiplier=2.0): return div(2.0 * multiplier * rstd(x, period), ravg(x, period), 0.0)


@op()
def PercentB(period=20, multiplier=2.0):
    m, d = ravg(x, period), multiplier * rstd(x, period)
    return div(x - (m - d), 2.0 * d, 0.5)


@op("candle")
def TrueRange(): return true_range()


@op("candle")
def ChaikinVolatility(ema_period=10, roc_period=10):
    e = ema(h - l, ema_period)
    return div(100.0 * (e - lag(e, roc_period)), lag(e, roc_period), 0.0)


@op()
def RviVolatility(period=10):
    s, d = rstd(x, period), x - lag(x)
    u, w = rma(where(d > 0.0, s, 0.0 * s), period), rma(where(d < 0.0, s, 0.0 * s), period)
    return div(100.0 * u, u + w, 50.0)


def annual(variance, n): return sqrt(mx(variance, 0.0) * float(n)) * 100.0


@op("candle")
def ParkinsonVolatility(period=20, trading_periods=252): return annual(ravg((ln(h) - ln(l)) ** 2.0, period) / (4 * math.log(2)), trading_periods)


@op("candle")
def GarmanKlassVolatility(period=20, trading_periods=252):
    return annual(ravg(0.5 * (ln(h) - ln(l)) ** 2.0 - (2 * math.log(2) - 1) * (ln(c) - ln(o)) ** 2.0, period), trading_periods)


def rogers_satchell():
    return (ln(h) - ln(c)) * (ln(h) - ln(o)) + (ln(l) - ln(c)) * (ln(l) - ln(o))


@op("candle")
def RogersSatchellVolatility(period=20, trading_periods=252): return annual(ravg(rogers_satchell(), period), trading_periods)


@op("candle")
def YangZhangVolatility(period=20, trading_periods=252):
    k = 0.34 / (1.34 + (period + 1) / (period - 1)) if period > 1 else 0.0
    night, day = ln(o) - ln(lag(c)), ln(c) - ln(o)
    return annual(roll("vars", period, night) + k * roll("vars", period, day) + (1 - k) * ravg(both(rogers_satchell(), night), period), trading_periods)


@op()
def JumpIndicator(period=20, threshold=3.0):
    m, s = lag(ravg(log_return, period)), lag(rstds(log_return, period))
    z = div(log_return - m, s, 0.0)
    return cases(z > threshold, 1.0, z < -threshold, -1.0, 0.0)


@op()
def RegimeLabel(vol_period=5, lookback=20):
    s = rstds(log_return, vol_period)
    a, b = rq(s, lookback, 0.25), rq(s, lookback, 0.75)
    return cases(s > b, 1.0, s < a, -1.0, 0.0)


def variance_recursion(a, b, w, start):
    """v = w + a r^2 + b v; from ``start``, or the first r^2 where that is None; emitted after the update."""

    def make():
        y = start

        def step(r):
            nonlocal y
            y = r * r if y is None else w + a * r * r + b * y
            return math.sqrt(y)

        return step

    return scan(make, log_return, tag=("variance", a, b, w, start))


@op()
def EwmaVolatility(decay=0.94): return variance_recursion(1 - decay, decay, 0.0, None)


@op()
def Garch11(omega=0.000_002, alpha=0.1, beta=0.88):
    def make():
        var, r2 = omega / (1 - alpha - beta), None

        def step(r):
            nonlocal var, r2
            if r2 is not None:
                var = omega + alpha * r2 + beta * var
            r2 = r * r
            return math.sqrt(var)

        return step

    return scan(make, log_return, tag=(omega, alpha, beta))


@op()
def VolatilityOfVolatility(vol_window=20, vov_window=20): return rstds(rstds(log_return, vol_window), vov_window)


@op()
def BipowerVariation(period=20):
    r = abs(log_return)
    return rsum(r * lag(r), period - 1) * (math.pi / 2) if period > 1 else log_return * 0.0


@op("candle")
def VolatilityRatio(period=14):
    t = mx(h - l, abs(h - lag(c)), abs(l - lag(c)))
    return div(t, lag(ema(t, period)), 0.0)


@op()
def VolatilityCone(window_=20, lookback=60):
    s = rstds(log_return, window_)

    def rank(w):
        return 100.0 * float((w <= w[-1]).sum()) / len(w)

    p = window(rank, lookback, s)
    return {"current": s + 0.0 * p, "min": rmin(s, lookback), "median": rq(s, lookback, 0.5), "max": rmax(s, lookback), "percentile": p}


op = family("Bands & Channels", "x")


@op()
def MaEnvelope(period=20, percent=0.025):
    m = ravg(x, period)
    return bands(m, percent * m)


@op("candle")
def AccelerationBands(period=20, factor=0.001):
    r = div(h - l, h + l, 0.0) * (4.0 * factor * 1000.0)
    return {"upper": ravg(h * (1.0 + r), period), "middle": ravg(c, period), "lower": ravg(l * (1.0 - r), period)}


@op("candle")
def StarcBands(sma_period=6, atr_period=15, multiplier=2.0): return bands(ravg(c, sma_period), multiplier * atr(atr_period))
@op("candle")
def AtrBands(period=14, multiplier=3.0): return bands(c, multiplier * atr(period))
@op("candle")
def HurstChannel(period=10, multiplier=0.5): return bands(ravg(c, period), multiplier * (rmax(h, period) - rmin(l, period)))


def residual_ss(value, n):
    return mx(float(n) * (rvar(value, n) - slope(value, n) ** 2.0 * ((n * n - 1) / 12.0)), 0.0)


@op()
def LinRegChannel(period=20, multiplier=2.0): return bands(endpoint(x, period), multiplier * sqrt(residual_ss(x, period) / float(period)))
@op()
def StandardErrorBands(period=21, multiplier=2.0): return bands(endpoint(x, period), multiplier * sqrt(residual_ss(x, period) / float(max(period - 2, 1))))


@op()
def DoubleBollinger(period=20, k_inner=1.0, k_outer=2.0):
    m, s = ravg(x, period), rstd(x, period)
    return {"upper_outer": m + k_outer * s, "upper_inner": m + k_inner * s, "middle": m, "lower_inner": m - k_inner * s, "lower_outer": m - k_outer * s}


@op("candle")
def TtmSqueeze(period=20, bb_mult=2.0, kc_mult=1.5):
    m = ravg(c, period)
    inside = bb_mult * rstd(c, period) <= kc_mult * atr(period)
    base = ((rmax(h, period) + rmin(l, period)) / 2.0 + m) / 2.0
    return {"squeeze": where(inside, 1.0, 0.0), "momentum": endpoint(c, period) - base}


def centred(value, k, highest):
    """The value k bars ago where it is strictly beyond its k neighbours on both sides."""
    m = lag(value, k)
    ok = None
    for i in [*range(k), *range(k + 1, 2 * k + 1)]:
        t = m > lag(value, i) if highest else m < lag(value, i)
        ok = t if ok is None else ok & t
    return only(ok, m)


@op("candle")
def FractalChaosBands(k=2):
    u, d = fill(centred(h, k, True)), fill(centred(l, k, False))
    return {"upper": u + 0.0 * d, "lower": d + 0.0 * u}


@op("candle")
def VwapStdDevBands(multiplier=2.0):
    s = csum(v)
    m = only(s > 0.0, div(csum(typical * v), s))
    d = sqrt(mx(div(csum(typical**2.0 * v), s) - m**2.0, 0.0))
    return bands(m, multiplier * d) | {"stddev": d}


@op()
def QuartileBands(period=20): return {"upper": rq(x, period, 0.75), "middle": rq(x, period, 0.5), "lower": rq(x, period, 0.25)}


def quantile_of(s, q):
    t = (len(s) - 1) * q
    i = min(int(t), len(s) - 1)
    return s[i] + (t - i) * (s[min(i + 1, len(s) - 1)] - s[i])


@op()
def BomarBands(period=20, coverage=0.85):
    def of(w):
        m = w.mean()
        return quantile_of(sorted(abs(w - m) / abs(m)), coverage) if m else 0.0

    m = ravg(x, period)
    return bands(m, window(of, period, x, tag=coverage) * abs(m))


@op()
def MedianChannel(period=20, multiplier=2.0):
    def mad(w):
        m = quantile_of(sorted(w), 0.5)
        return quantile_of(sorted(abs(w - m)), 0.5)

    return bands(rq(x, period, 0.5), multiplier * window(mad, period, x))


def projected(n):
    def hi(w, s):
        return float(max(w[i] + s[-1] * (len(w) - 1 - i) for i in range(len(w))))

    def lo(w, s):
        return float(min(w[i] + s[-1] * (len(w) - 1 - i) for i in range(len(w))))

    f = lambda w: fn("coalesce", slope(w, n), 0.0)
    a, b = window(hi, n, h, f(h)), window(lo, n, l, f(l))
    return {"upper": a, "middle": (a + b) / 2.0, "lower": b}


@op("candle")
def ProjectionBands(period=14): return projected(period)


@op("candle")
def ProjectionOscillator(period=14):
    b = projected(period)
    return div(100.0 * (c - b["lower"]), b["upper"] - b["lower"], 50.0)
