"""Price statistics, single series and pairs."""

import math

import numpy as np

from ..plans.expr import *  # noqa: F403
from ..plans.expr import rsi as rsi_of
from .catalog import family
from .common import c, h, l, o, x, y
from .momentum import endpoint
from .trend import r_squared
from .volatility import log_return, quantile_of, residual_ss

op = family("Price Statistics", "x")


@op("candle")
def TypicalPrice(): return (h + l + c) / 3.0
@op("candle")
def MedianPrice(): return (h + l) / 2.0
@op("candle")
def WeightedClose(): return (h + l + 2.0 * c) / 4.0
@op()
def LinearRegression(period=14): return endpoint(x, period)
@op()
def LinRegSlope(period=14): return slope(x, period)
@op()
def ZScore(period=20): return div(x - ravg(x, period), rstd(x, period), 0.0)
@op()
def LinRegAngle(period=14): return fn("atan", slope(x, period)) * (180.0 / math.pi)
@op()
def Variance(period=20): return rvar(x, period)
@op()
def CoefficientOfVariation(period=20): return div(rstd(x, period), ravg(x, period), 0.0)
@op()
def Skewness(period=20): return roll("skew", period, x)
@op()
def Kurtosis(period=20): return roll("kurt", period, x)
@op()
def StandardError(period=14): return sqrt(residual_ss(x, period) / float(max(period - 2, 1)))
@op()
def DetrendedStdDev(period=14): return sqrt(residual_ss(x, period) / float(period))
@op()
def RSquared(period=14): return clamp(r_squared(x, period, 1.0), 0.0, 1.0)


def mad(w):
    m = quantile_of(sorted(w), 0.5)
    return quantile_of(sorted(abs(w - m)), 0.5)


@op()
def MedianAbsoluteDeviation(period=20): return window(mad, period, x)


@op()
def Autocorrelation(period=20, lag_=1):
    def of(w):
        d = w - w.mean()
        s = float(d @ d)
        return float(d[lag_:] @ d[:-lag_]) / s if s else 0.0

    return window(of, period, x, tag=lag_)


@op()
def HurstExponent(period=100, chunks=4):
    def of(w):
        n, pts = len(w), []
        for k in range(1, chunks + 1):
            size = n // k
            if size < 2:
                continue
            got = []
            for i in range(k):
                part = w[i * size : (i + 1) * size]
                z = np.cumsum(part - part.mean())
                r, s = z.max() - z.min(), part.std()
                if s > 0 and r > 0:
                    got.append(r / s)
            if got:
                pts.append((math.log(size), math.log(sum(got) / len(got))))
        if len(pts) < 2:
            return 0.5
        a, b = np.array(pts).T
        d = a - a.mean()
        return min(1.0, max(0.0, float(d @ (b - b.mean())) / float(d @ d))) if d @ d else 0.5

    return window(of, period, x, tag=chunks)


def correlation(a, b, n):
    return clamp(div(rcov(a, b, n), rstd(both(a, b), n) * rstd(both(b, a), n), 0.0), -1.0, 1.0)


@op("pair")
def PearsonCorrelation(period=20): return correlation(x, y, period)


def beta_of(a, b, n): return div(rcov(a, b, n), rvar(both(b, a), n), 0.0)


@op("pair")
def Beta(period=20): return beta_of(x, y, period)


def mid_ranks(w):
    s = np.sort(w)
    return (np.searchsorted(s, w, "left") + np.searchsorted(s, w, "right") + 1) / 2.0


@op("pair")
def SpearmanCorrelation(period=20):
    def of(a, b):
        a, b = mid_ranks(a), mid_ranks(b)
        a, b = a - a.mean(), b - b.mean()
        d = math.sqrt(float(a @ a) * float(b @ b))
        return float(a @ b) / d if d else 0.0

    return window(of, period, x, y)


def ols(rows, target):
    """Coefficients and residual sum of squares; None if singular."""
    m = rows.T @ rows
    try:
        if abs(np.linalg.det(m)) < 1e-300:
            return None
        k = np.linalg.solve(m, rows.T @ target)
    except np.linalg.LinAlgError:
        return None
    r = target - rows @ k
    return k, float(r @ r), m


@op("pair")
def Cointegration(period=30, adf_lags=1):
    def of(a, b):
        v = b.var()
        k = float(((a - a.mean()) * (b - b.mean())).mean() / v) if v else 0.0
        s = a - k * b - (a.mean() - k * b.mean())
        d = np.diff(s)
        rows = [[s[t], *(d[t - i] for i in range(1, adf_lags + 1))] for t in range(adf_lags, len(d))]
        stat = 0.0
        if len(rows) > adf_lags + 1:
            got = ols(np.array(rows), d[adf_lags:])
            if got:
                w, rss, m = got
                var = rss / (len(rows) - adf_lags - 1) * np.linalg.inv(m)[0, 0]
                stat = float(w[0] / math.sqrt(var)) if var > 0 else 0.0
        return k, float(s[-1]), stat

    return picks(window(of, period, x, y, outs=3, tag=adf_lags), "hedge_ratio spread adf_stat")


@op("pair")
def LeadLagCrossCorrelation(window_=20, max_lag=10):
    def of(a, b):
        best = (0.0, 0.0)
        n = window_
        first = True
        for k in range(-max_lag, max_lag + 1):
            at = max_lag
            p, q = a[at : at + n], b[at + k : at + k + n]
            p, q = p - p.mean(), q - q.mean()
            d = math.sqrt(float(p @ p) * float(q @ q))
            r = float(p @ q) / d if d else 0.0
            if first or abs(r) > abs(best[1]):
                best, first = (float(k), r), False
        return best

    return picks(window(of, window_ + 2 * max_lag, x, y, outs=2, tag=(window_, max_lag)), "lag correlation")


@op("pair")
def PairSpreadZScore(beta_period=20, z_period=20):
    a, b = ln(x), ln(y)
    s = a - beta_of(a, b, beta_period) * b
    return div(s - ravg(s, z_period), rstd(s, z_period), 0.0)


@op("pair")
def PairwiseBeta(period=20): return beta_of(ln(x) - ln(lag(x)), ln(y) - ln(lag(y)), period)


@op("pair")
def RelativeStrengthAB(ma_period=20, rsi_period=14):
    r = div(x, y)
    m, s = ravg(r, ma_period), rsi_of(r, rsi_period)
    ready = 0.0 * (m + s)
    return {"ratio": r + ready, "ratio_ma": m + ready, "ratio_rsi": s + ready}


@op("candle")
def MidPrice(period=14): return (rmax(h, period) + rmin(l, period)) / 2.0
@op()
def MidPoint(period=14): return (rmax(x, period) + rmin(x, period)) / 2.0
@op("candle")
def AvgPrice(): return (o + h + l + c) / 4.0
@op()
def LinRegIntercept(period=14): return ravg(x, period) - slope(x, period) * ((period - 1) / 2.0)
@op()
def Tsf(period=14): return ravg(x, period) + slope(x, period) * ((period + 1) / 2.0)


dx, dy = x - lag(x), y - lag(y)


@op("pair")
def RollingCorrelation(period=20): return correlation(dx, dy, period)
@op("pair")
def RollingCovariance(period=20): return rcov(dx, dy, period)


def ar1(s, n): return beta_of(s - lag(s), lag(s), n - 1)


@op("pair")
def OuHalfLife(period=60):
    k = ar1(x - y, period)
    return where(k < 0.0, div(-math.log(2), k, 0.0), 0.0)


@op("pair")
def SpreadHurst(period=60):
    def of(s):
        n, pts = len(s), []
        for k in range(1, max(2, n // 4) + 1):
            d = s[k:] - s[:-k]
            if (v := float((d * d).mean())) > 0:
                pts.append((math.log(k), math.log(v)))
        if len(pts) < 2:
            return 0.5
        a, b = np.array(pts).T
        d = a - a.mean()
        return min(1.0, max(0.0, float(d @ (b - b.mean())) / float(d @ d) / 2))

    return window(of, period, x - y)


@op("pair")
def DistanceSsd(period=20):
    def of(a, b):
        return float(((a / a[0] - b / b[0]) ** 2).sum()) if a[0] and b[0] else 0.0

    return window(of, period, x, y)


@op("pair")
def BetaNeutralSpread(period=20):
    k = beta_of(x, y, period)
    return x - (ravg(both(x, y), period) - k * ravg(both(y, x), period)) - k * y


@op("pair")
def VarianceRatio(period=60, q=2):
    def of(s):
        d = np.diff(s)
        m = d.mean()
        one = float(((d - m) ** 2).sum()) / len(d)
        if one <= 0:
            return 1.0
        z = s[q:] - s[:-q]
        return float(((z - q * m) ** 2).sum()) / len(z) / (q * one)

    return window(of, period, x - y, tag=q)


@op("pair")
def GrangerCausality(period=60, lag_=1):
    def of(a, b):
        n = len(a)
        own = np.array([[1.0, *(a[t - i] for i in range(1, lag_ + 1))] for t in range(lag_, n)])
        full = np.array([[*own[t - lag_], *(b[t - i] for i in range(1, lag_ + 1))] for t in range(lag_, n)])
        r, u = ols(own, a[lag_:]), ols(full, a[lag_:])
        k = len(own) - 2 * lag_ - 1
        if not r or not u or k <= 0 or u[1] <= 0:
            return 0.0
        return max(0.0, (r[1] - u[1]) / lag_ / (u[1] / k))

    return window(of, period, x, y, tag=lag_)


@op("pair")
def KalmanHedgeRatio(delta=1e-4, observation_var=1e-3):
    q = delta / (1 - delta)

    def make():
        b = np.zeros(2)
        p = np.zeros((2, 2))

        def step(a, z):
            nonlocal b, p
            p = p + q * np.eye(2)
            f = np.array([z, 1.0])
            e = a - f @ b
            s = f @ p @ f + observation_var
            k = p @ f / s
            b = b + k * e
            p = p - np.outer(k, f @ p)
            return float(b[0]), float(b[1]), float(e)

        return step

    return picks(scan(make, x, y, outs=3, tag=(delta, observation_var)), "hedge_ratio intercept spread")


@op("pair")
def SpreadBollingerBands(period=20, num_std=2.0):
    s = x - y
    m, d = ravg(s, period), num_std * rstd(s, period)
    return {"middle": m, "upper": m + d, "lower": m - d, "percent_b": div(s - m + d, 2.0 * d, 0.5)}


@op()
def LogReturn(period=1): return ln(x) - ln(lag(x, period))
@op()
def RealizedVolatility(period=20): return sqrt(rsum(log_return**2.0, period))
@op()
def RollingIqr(period=14): return rq(x, period, 0.75) - rq(x, period, 0.25)


@op()
def RollingPercentileRank(period=14):
    def of(w):
        return 100.0 * float((w < w[-1]).sum() + 0.5 * (w == w[-1]).sum()) / len(w)

    return window(of, period, x)


@op()
def RollingQuantile(period=20, quantile=0.5): return rq(x, period, quantile)
@op("pair")
def SpreadAr1Coefficient(period=40): return beta_of(x - y, lag(x - y), period - 1)
@op("candle")
def CloseVsOpen(): return div(c - o, o, 0.0)
@op("candle")
def BodySizePct(): return div(abs(c - o), h - l, 0.0)
@op("candle")
def WickRatio(): return div((h - mx(o, c)) - (mn(o, c) - l), h - l, 0.0)
@op("candle")
def HighLowRange(): return div(h - l, c, 0.0)


@op()
def JarqueBera(period=20):
    s, k = roll("skew", period, x), roll("kurt", period, x)
    return where(eq(rvar(x, period), 0.0), 0.0, (s**2.0 + k**2.0 / 4.0) * (period / 6.0))


@op()
def RollingMinMaxScaler(period=14): return div(x - rmin(x, period), rmax(x, period) - rmin(x, period), 0.5)


@op()
def ShannonEntropy(period=20, bins=10):
    def of(w):
        lo, hi = w.min(), w.max()
        if hi <= lo:
            return 0.0
        p = np.bincount(np.minimum(((w - lo) / (hi - lo) * bins).astype(int), bins - 1)) / len(w)
        p = p[p > 0]
        return float(-(p * np.log2(p)).sum())

    return window(of, period, x, tag=bins)


@op()
def SampleEntropy(period=30, m=2, r_factor=0.2):
    def of(w):
        tol = r_factor * w.std()
        if tol == 0:
            return 0.0
        n, counts = len(w), [0, 0]
        for i in range(n - m):
            for j in range(i + 1, n - m):
                if abs(w[i : i + m] - w[j : j + m]).max() <= tol:
                    counts[0] += 1
                    counts[1] += abs(w[i + m] - w[j + m]) <= tol
        if not counts[0]:
            return 0.0
        return math.log(counts[0]) if not counts[1] else -math.log(counts[1] / counts[0])

    return window(of, period, x, tag=(m, r_factor))


@op("pair")
def KendallTau(period=20):
    def of(a, b):
        i, j = np.triu_indices(len(a), 1)
        p, q = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
        d = math.sqrt(float((p != 0).sum()) * float((q != 0).sum()))
        return float((p * q).sum()) / d if d else 0.0

    return window(of, period, x, y)
