"""Momentum oscillators."""


from ..plans.expr import *  # noqa: F403
from ..plans.expr import rsi as rsi_of
from .averages import cmo
from .catalog import family
from .common import c, h, l, o, true_range, typical, v, x

op = family("Momentum Oscillators", "x")


@op()
def Rsi(period=14): return rsi_of(x, period)


@op()
def AnchoredRsi():
    d = x - lag(x)
    g, s = csum(mx(d, 0.0)), csum(mx(-d, 0.0))
    return div(100.0 * g, g + s, 50.0)


def stochastic_of(value, hi, lo, n):
    a, b = rmax(hi, n), rmin(lo, n)
    return div(100.0 * (value - b), a - b, 50.0)


@op("candle")
def Stochastic(k_period=14, d_period=3):
    k = stochastic_of(c, h, l, k_period)
    d = ravg(k, d_period)
    return {"k": k + 0.0 * d, "d": d}


def mean_deviation(w):
    m = w.mean()
    return float(abs(w - m).mean())


def cci_of(value, n, factor=0.015):
    mad = window(mean_deviation, n, value)
    return div(value - ravg(value, n), factor * mad, 0.0)


@op("candle")
def Cci(period=20): return cci_of(typical, period)
@op()
def Roc(period=10): return div(100.0 * (x - lag(x, period)), lag(x, period), 0.0)


@op("candle")
def WilliamsR(period=14):
    a, b = rmax(h, period), rmin(l, period)
    return div(-100.0 * (a - c), a - b, -50.0)


@op("candle")
def Mfi(period=14):
    d = typical - lag(typical)
    f = typical * v
    p, n = rsum(where(d > 0.0, f, 0.0), period), rsum(where(d < 0.0, f, 0.0), period)
    return cases(eq(p, 0.0) & eq(n, 0.0), 50.0, eq(n, 0.0), 100.0, 100.0 - 100.0 / (1.0 + div(p, n, 0.0)))


def awesome(fast, slow):
    m = (h + l) / 2.0
    return ravg(m, fast) - ravg(m, slow)


@op("candle")
def AwesomeOscillator(fast=5, slow=34): return awesome(fast, slow)
@op()
def Mom(period=10): return x - lag(x, period)
@op()
def Cmo(period=14): return cmo(x, period)


@op()
def Tsi(long=25, short=13):
    d = x - lag(x)
    return div(100.0 * ema(ema(d, long), short), ema(ema(abs(d), long), short), 0.0)


@op()
def Pmo(smoothing1=35, smoothing2=20):
    r = div(100.0 * (x - lag(x)), lag(x), 0.0)
    return ema(10.0 * ema(r, alpha=2.0 / smoothing1), alpha=2.0 / smoothing2)


@op()
def StochRsi(rsi_period=14, stoch_period=14):
    r = rsi_of(x, rsi_period)
    return stochastic_of(r, r, r, stoch_period)


@op("candle")
def UltimateOscillator(short=7, mid=14, long=28):
    p = lag(c)
    bp, tr = c - mn(l, p), mx(h, p) - mn(l, p)
    part = lambda n: div(rsum(bp, n), rsum(tr, n), 0.5)
    return 100.0 * (4.0 * part(short) + 2.0 * part(mid) + part(long)) / 7.0


def rvi_of(period):
    a, b = rsum(c - o, period), rsum(h - l, period)
    return fill(only(b > 0.0, div(a, b)))


@op("candle")
def Rvi(period=10): return rvi_of(period)


@op("candle")
def Pgo(period=14):
    e = ema(true_range(), period)
    return fill(only(e > 0.0, div(c - ravg(c, period), e)))


@op()
def Kst(roc1=10, roc2=15, roc3=20, roc4=30, sma1=10, sma2=10, sma3=10, sma4=15, signal=9):
    parts = [(roc1, sma1), (roc2, sma2), (roc3, sma3), (roc4, sma4)]
    k = 0.0
    for i, (r, s) in enumerate(parts, 1):
        k = k + float(i) * ravg(Roc(r), s)
    g = ravg(k, signal)
    return {"kst": k + 0.0 * g, "signal": g}


@op("candle")
def Smi(period=5, d_period=3, d2_period=3):
    a, b = rmax(h, period), rmin(l, period)
    m, r = c - (a + b) / 2.0, a - b
    top, low = ema(ema(m, d_period), d2_period), ema(ema(r, d_period), d2_period)
    return fill(only(low > 0.0, div(100.0 * top, low / 2.0)))


@op()
def LaguerreRsi(gamma=0.5):
    def make():
        s = None

        def step(a):
            nonlocal s
            s = s or [a] * 4
            l0 = (1 - gamma) * a + gamma * s[0]
            l1 = -gamma * l0 + s[0] + gamma * s[1]
            l2 = -gamma * l1 + s[1] + gamma * s[2]
            l3 = -gamma * l2 + s[2] + gamma * s[3]
            s = [l0, l1, l2, l3]
            d = (l0 - l1, l1 - l2, l2 - l3)
            up, down = sum(z for z in d if z > 0), -sum(z for z in d if z < 0)
            return 100 * up / (up + down) if up + down else 50.0

        return step

    return scan(make, x, tag=gamma)


@op()
def ConnorsRsi(period_rsi=3, period_streak=2, period_rank=100):
    def make():
        k, p = 0.0, None

        def step(a):
            nonlocal k, p
            if p is None:
                p = a
                return None
            k = max(k, 0) + 1 if a > p else min(k, 0) - 1 if a < p else 0.0
            p = a
            return k

        return step

    streak = scan(make, x, tag="streak")
    r = div(100.0 * (x - lag(x)), lag(x), 0.0)

    def rank(w):
        return 100.0 * float((w < w[-1]).sum()) / len(w)

    return (rsi_of(x, period_rsi) + rsi_of(streak, period_streak) + window(rank, period_rank, r)) / 3.0


def endpoint(value, n): return ravg(value, n) + slope(value, n) * ((n - 1) / 2.0)


@op("candle")
def Inertia(rvi_period=14, linreg_period=20): return endpoint(rvi_of(rvi_period), linreg_period)
@op()
def Rocp(period=10): return div(x - lag(x, period), lag(x, period), 0.0)
@op()
def Rocr(period=10): return div(x, lag(x, period), 0.0)
@op()
def Rocr100(period=10): return div(100.0 * x, lag(x, period), 0.0)


@op()
def DisparityIndex(period=14):
    m = ravg(x, period)
    return div(100.0 * (x - m), m, 0.0)


@op()
def FisherRsi(period=14):
    r = clamp((rsi_of(x, period) - 50.0) / 50.0, -0.999, 0.999)
    return 0.5 * ln((1.0 + r) / (1.0 - r))


@op()
def Rsx(length=14):
    a = 3.0 / (length + 2.0)
    b = 1.0 - a

    def make():
        s, p, n = [0.0] * 12, None, 0

        def smooth(z, k):
            for i in range(k, k + 6, 2):
                s[i] = b * s[i] + a * z
                s[i + 1] = a * s[i] + b * s[i + 1]
                z = 1.5 * s[i] - 0.5 * s[i + 1]
            return z

        def step(z):
            nonlocal p, n
            if p is None:
                p = z
                return None
            d, p = z - p, z
            n += 1
            up, all_ = smooth(d, 0), smooth(abs(d), 6)
            if n < length:
                return None
            return min(100.0, max(0.0, (up / all_ + 1) * 50)) if all_ > 0 else 50.0

        return step

    return scan(make, x, tag=length)


@op()
def DynamicMomentumIndex(period=14):
    sd = rstd(x, 5)
    av = ravg(sd, 10)
    ratio = div(sd, av, 0.0)
    td = where((sd > 0.0) & (av > 0.0), clamp(fn("round", div(float(period), ratio, 1e9)), 5.0, 30.0), 30.0)

    def of(d, k):
        d = d[-int(k[-1]) :]
        g, s = d[d > 0].sum(), -d[d < 0].sum()
        return 100 * g / (g + s) if g + s else 50.0

    return window(of, 30, x - lag(x), both(fn("coalesce", td, 30.0), x), tag=period)


@op("candle")
def StochasticCci(period=14):
    k = cci_of(typical, period)
    return stochastic_of(k, k, k, period)


@op()
def Rmi(period=14, momentum=5):
    d = x - lag(x, momentum)
    g, s = rma(mx(d, 0.0), period), rma(mx(-d, 0.0), period)
    return div(100.0 * g, g + s, 50.0)


@op()
def DerivativeOscillator(rsi_period=14, smooth1=5, smooth2=3, signal_period=9):
    e = ema(ema(rsi_of(x, rsi_period), smooth1), smooth2)
    return e - ravg(e, signal_period)


@op("candle")
def ElderRay(period=13):
    e = ema(c, period)
    return {"bull_power": h - e, "bear_power": l - e}


@op("candle")
def IntradayMomentumIndex(period=14):
    b = c - o
    u, d = rsum(mx(b, 0.0), period), rsum(mx(-b, 0.0), period)
    return div(100.0 * u, u + d, 50.0)


@op()
def Qqe(rsi_period=14, smoothing=5, factor=4.236):
    r = ema(rsi_of(x, rsi_period), smoothing)
    n = 2 * rsi_period - 1
    band = factor * ema(ema(abs(r - lag(r)), n), n)

    def make():
        lo = hi = p = None
        up = True

        def step(a, d):
            nonlocal lo, hi, p, up
            nl, nh = a - d, a + d
            if lo is None:
                lo, hi = nl, nh
            else:
                ol, oh = lo, hi
                lo = max(nl, lo) if p > lo and a > lo else nl
                hi = min(nh, hi) if p < hi and a < hi else nh
                if a > oh:
                    up = True
                elif a < ol:
                    up = False
            p = a
            return a, lo if up else hi

        return step

    return picks(scan(make, r, band, outs=2, tag=(rsi_period, smoothing, factor)), "rsi_ma trailing_line")


