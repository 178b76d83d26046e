"""Volume operators."""

from ..plans.expr import *  # noqa: F403
from .catalog import family
from .common import c, h, l, typical, v

op = family("Volume", "candle")
dc = c - lag(c)
money_flow = div((c - l) - (h - c), h - l, 0.0) * v


def from_start(node_):
    """0 in place of the missing value of the first bar."""
    return fn("coalesce", node_, 0.0)


@op()
def Obv(): return csum(from_start(sign(dc) * v))


@op()
def Vwap():
    s = csum(v)
    return only(s > 0.0, div(csum(typical * v), s))


@op()
def RollingVwap(period=20):
    s = rsum(v, period)
    return only(s > 0.0, div(rsum(typical * v, period), s))


adl = csum(money_flow)


@op()
def Adl(): return adl
@op()
def VolumePriceTrend(): return csum(from_start(div(dc, lag(c), 0.0) * v))
@op()
def ChaikinMoneyFlow(period=20): return div(rsum(money_flow, period), rsum(v, period), 0.0)
@op()
def ChaikinOscillator(fast=3, slow=10): return ema(adl, fast) - ema(adl, slow)
@op()
def ForceIndex(period=13): return ema(dc * v, period)


@op()
def EaseOfMovement(period=14, divisor=100_000_000.0):
    m = (h + l) / 2.0
    return ravg(div((m - lag(m)) * (h - l) * divisor, v, 0.0), period)


@op()
def Kvo(fast=34, slow=55):
    def make():
        p, way, total = None, 0, 0.0

        def step(dm, vol):
            nonlocal p, way, total
            if p is None:
                p = dm
                return None
            now = 1 if dm > p else -1 if dm < p else way
            total = total + dm if now == way and way else p + dm
            p, way = dm, now
            return vol * abs(2 * (dm / total - 1)) * now * 100 if total else 0.0

        return step

    f = scan(make, h + l + c, v)
    return ema(f, fast) - ema(f, slow)


@op()
def VolumeOscillator(fast=14, slow=28):
    s = ravg(v, slow)
    return div(100.0 * (ravg(v, fast) - s), s, 0.0)


def compounding(rising, baseline):
    def make():
        y, pc, pv = baseline, None, None

        def step(close, vol):
            nonlocal y, pc, pv
            if pc and (vol > pv if rising else vol < pv):
                y += y * (close - pc) / pc
            pc, pv = close, vol
            return y

        return step

    return scan(make, c, v, tag=(rising, baseline))


@op()
def Nvi(baseline=1000.0): return compounding(False, baseline)
@op()
def Pvi(baseline=1000.0): return compounding(True, baseline)


def williams_ad():
    p = lag(c)
    return cases(c > p, c - mn(l, p), c < p, c - mx(h, p), 0.0)


@op()
def AdOscillator(signal_period=13):
    a = csum(williams_ad())
    return a - ravg(a, signal_period)


@op()
def AnchoredVwap(): return Vwap()


@op()
def DemandIndex(period=10):
    p = lag(c)
    return ema(div(c - p, p, 0.0) * (1.0 + div(h - l, p, 0.0)) * v, period)


@op()
def Tsv(period=18): return rsum(dc * v, period)
@op()
def Vzo(period=14): return div(100.0 * ema(sign(dc) * v, period), ema(both(v, dc), period), 0.0)
@op()
def MarketFacilitationIndex(): return only(v > 0.0, div(h - l, v))


@op()
def VolumeRsi(period=14):
    d = v - lag(v)
    g, s = rma(mx(d, 0.0), period), rma(mx(-d, 0.0), period)
    return div(100.0 * g, g + s, 50.0)


@op()
def Wad(): return csum(williams_ad())


@op()
def TwiggsMoneyFlow(period=21):
    a, b = mx(h, lag(c)), mn(l, lag(c))
    f = div((c - b) - (a - c), a - b, 0.0) * v
    return div(rma(f, period), rma(both(v, f), period), 0.0)


@op()
def TradeVolumeIndex(min_tick=0.25):
    d = fill(cases(dc > min_tick, 1.0, dc < -min_tick, -1.0, only(eq(1.0, 0.0), dc)))
    return csum(both(fn("coalesce", d, 0.0) * v, dc))


@op()
def IntradayIntensity(): return div((2.0 * c - h - l) * v, h - l, 0.0)
@op()
def BetterVolume(period=14): return div(v, ravg(v, period), 0.0) - div(h - l, ravg(h - l, period), 0.0)


@op()
def VolumeWeightedMacd(fast=12, slow=26, signal=9):
    def w(n):
        s = rsum(v, n)
        return where(s > 0.0, fn("div", rsum(c * v, n), s), ravg(c, n))

    m = w(fast) - w(slow)
    g = ema(m, signal)
    return {"macd": m + 0.0 * g, "signal": g, "histogram": m - g}


