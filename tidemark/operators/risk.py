"""Risk and performance operators over returns or equity samples."""

import math

import numpy as np

from ..plans.expr import *  # noqa: F403
from .catalog import family
from .common import x, y
from .volatility import quantile_of

op = family("Risk / Performance", "x")
INF = float("inf")


def ratio(gain, loss):
    """gain / loss; without losses infinity, or 1 without gains as well."""
    return cases(loss > 0.0, div(gain, loss), gain > 0.0, INF, 1.0)


@op()
def SharpeRatio(period=20, risk_free=0.0): return div(ravg(x, period) - risk_free, rstds(x, period), 0.0)
@op()
def SortinoRatio(period=20, mar=0.0): return div(ravg(x, period) - mar, sqrt(ravg(mn(x - mar, 0.0) ** 2.0, period)), 0.0)


def curve_drawdowns(w):
    """Drawdowns of the compounded curve of a window of returns, from a start of 1."""
    e = np.cumprod(1 + w)
    peak = np.maximum(np.maximum.accumulate(e), 1.0)
    return (peak - e) / peak


def level_drawdowns(w):
    peak = np.maximum.accumulate(w)
    with np.errstate(all="ignore"):
        return np.where(peak > 0, (peak - w) / peak, 0.0)


def over(mean, risk): return 0.0 if not risk or risk != risk else float(mean / risk)


@op()
def CalmarRatio(period=36): return window(lambda w: over(w.mean(), curve_drawdowns(w).max()), period, x, tag="calmar")
@op()
def OmegaRatio(period=20, threshold=0.0): return ratio(rsum(mx(x - threshold, 0.0), period), rsum(mx(threshold - x, 0.0), period))
@op()
def MaxDrawdown(period=20): return window(lambda w: float(level_drawdowns(w).max()), period, x, tag="mdd")


def episodes(d):
    """Depth of each stretch below the peak."""
    out, depth = [], 0.0
    for z in d:
        if z > 0:
            depth = max(depth, z)
        elif depth:
            out.append(depth)
            depth = 0.0
    return out + [depth] if depth else out


def mean_episode(d):
    e = episodes(d)
    return sum(e) / len(e) if e else 0.0


@op()
def AverageDrawdown(period=20): return window(lambda w: float(mean_episode(level_drawdowns(w))), period, x, tag="add")


@op()
def DrawdownDuration():
    def make():
        peak, n = -INF, 0

        def step(a):
            nonlocal peak, n
            peak, n = (a, 0) if a >= peak else (peak, n + 1)
            return float(n)

        return step

    return scan(make, x)


@op()
def PainIndex(period=14): return window(lambda w: float(level_drawdowns(w).mean()), period, x, tag="pain")
@op()
def ValueAtRisk(period=20, confidence=0.95): return mx(-rq(x, period, 1 - confidence), 0.0)


@op()
def ConditionalValueAtRisk(period=20, confidence=0.95):
    k = max(1, int((1 - confidence) * period + 1e-9))
    return window(lambda w: max(0.0, -float(np.sort(w)[:k].mean())), period, x, tag=("cvar", confidence))


def gains(n): return rsum(mx(x, 0.0), n)
def losses(n): return rsum(mx(-x, 0.0), n)
def count(cond, n): return rsum(where(cond, 1.0, 0.0), n)


@op()
def ProfitFactor(period=20): return ratio(gains(period), losses(period))


@op()
def GainLossRatio(period=20):
    w, k = count(x > 0.0, period), count(x < 0.0, period)
    return cases(eq(k, 0.0), where(eq(w, 0.0), 1.0, INF), eq(w, 0.0), 0.0, div(div(gains(period), w), div(losses(period), k)))


@op()
def RecoveryFactor():
    def make():
        first = peak = None
        worst = 0.0

        def step(a):
            nonlocal first, peak, worst
            first = a if first is None else first
            peak = a if peak is None else max(peak, a)
            if peak > 0:
                worst = max(worst, (peak - a) / peak)
            return None if not first else ((a - first) / first) / worst if worst else 0.0

        return step

    return scan(make, x)


@op()
def KellyCriterion(period=20):
    w, k = count(x > 0.0, period), count(x < 0.0, period)
    p = div(w, float(period))
    pay = div(div(gains(period), w, 0.0), div(losses(period), k, 1.0), 1.0)
    return cases(eq(k, 0.0), p, eq(w, 0.0), -1.0, p - div(1.0 - p, pay))


def beta_pair(n): return div(rcov(x, y, n), rvar(both(y, x), n), 0.0)


@op("pair")
def TreynorRatio(period=20, risk_free=0.0): return div(ravg(both(x, y), period) - risk_free, beta_pair(period), 0.0)
@op("pair")
def InformationRatio(period=20): return div(ravg(x - y, period), rstds(x - y, period), 0.0)


@op("pair")
def Alpha(period=20, risk_free=0.0):
    return ravg(both(x, y), period) - (risk_free + beta_pair(period) * (ravg(both(y, x), period) - risk_free))


@op()
def WinRate(period=20): return count(x > 0.0, period) / float(period)


@op()
def Expectancy(period=20):
    k = count(x < 0.0, period)
    return where(eq(k, 0.0), 0.0, div(ravg(x, period), div(losses(period), k, 1.0), 0.0))


@op()
def SterlingRatio(period=12): return window(lambda w: over(w.mean(), curve_drawdowns(w).mean()), period, x, tag="sterling")
@op()
def BurkeRatio(period=12): return window(lambda w: over(w.mean(), math.sqrt((curve_drawdowns(w) ** 2).sum())), period, x, tag="burke")
@op()
def MartinRatio(period=14): return window(lambda w: over(w.mean(), math.sqrt((curve_drawdowns(w) ** 2).mean())), period, x, tag="martin")
@op()
def TailRatio(period=20): return div(rq(x, period, 0.95), abs(rq(x, period, 0.05)), 0.0)


@op()
def KRatio(period=30):
    def of(w):
        e = np.cumsum(w)
        n = len(e)
        t = np.arange(n) - (n - 1) / 2
        b = float(t @ e) / float(t @ t)
        r = e - e.mean() - b * t
        sse = float(r @ r)
        return b / math.sqrt(sse / (n - 2) / float(t @ t)) if sse > 0 and n > 2 else 0.0

    return window(of, period, x)


@op()
def CommonSenseRatio(period=20):
    tail = div(rq(x, period, 0.95), abs(rq(x, period, 0.05)), 0.0)
    return div(gains(period), losses(period), 0.0) * tail


@op()
def GainToPainRatio(period=12): return div(rsum(x, period), losses(period), 0.0)
@op()
def UpsidePotentialRatio(period=20, mar=0.0): return div(ravg(mx(x - mar, 0.0), period), sqrt(ravg(mn(x - mar, 0.0) ** 2.0, period)), 0.0)
@op()
def M2Measure(period=20, risk_free=0.0, benchmark_stddev=0.01): return risk_free + div(ravg(x, period) - risk_free, rstds(x, period), 0.0) * benchmark_stddev
