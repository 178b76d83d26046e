"""Derivatives, microstructure and market breadth."""

import math

import numpy as np

from ..plans.expr import *  # noqa: F403
from .catalog import family

op = family("Derivatives", "derivatives")
rate, mark, index, futures, oi, longs, shorts, buys, sells, long_liq, short_liq = (
    col(k) for k in ("funding_rate", "mark_price", "index_price", "futures_price", "open_interest", "long_size", "short_size", "taker_buy_volume", "taker_sell_volume", "long_liquidation", "short_liquidation")
)


@op()
def FundingRate(): return rate * 1.0
@op()
def FundingRateMean(window_=20): return ravg(rate, window_)
@op()
def FundingRateZScore(window_=20): return div(rate - ravg(rate, window_), rstd(rate, window_), 0.0)
@op()
def FundingBasis(): return div(mark - index, index)
@op()
def OpenInterestDelta(): return oi - lag(oi)


@op()
def OIPriceDivergence(window_=20):
    change = lambda z: div(z - lag(z, window_), lag(z, window_), 0.0)
    return change(oi) - change(mark)


@op()
def OIWeighted():
    s = csum(oi)
    return where(eq(s, 0.0), mark, div(csum(mark * oi), s))


@op()
def LongShortRatio(): return div(longs, shorts, 0.0)
@op()
def TakerBuySellRatio(): return div(buys, sells, 0.0)


@op()
def LiquidationFeatures():
    t, n = long_liq + short_liq, long_liq - short_liq
    return {"long": long_liq * 1.0, "short": short_liq * 1.0, "net": n, "total": t, "imbalance": div(n, t, 0.0)}


@op()
def TermStructureBasis(): return div(futures - index, index)
@op()
def CalendarSpread(): return div(futures - mark, mark)
@op()
def EstimatedLeverageRatio(): return div(oi, longs + shorts, 0.0)
@op()
def OiToVolumeRatio(): return div(oi, buys + sells, 0.0)
@op()
def PerpetualPremiumIndex(): return div(mark - index, index)
@op()
def FundingImpliedApr(intervals_per_year=1095.0): return rate * intervals_per_year
@op()
def OpenInterestMomentum(period=10): return div(100.0 * (oi - lag(oi, period)), lag(oi, period), 0.0)


# Trades: side is 1 for a buyer, -1 for a seller as aggressor.
op = family("Microstructure", "trade")
price, size, side, mid = col("price"), col("size"), col("side"), col("mid")


@op()
def SignedVolume(): return side * size
@op()
def CumulativeVolumeDelta(): return csum(side * size)
@op()
def TradeImbalance(window_=20): return div(rsum(side * size, window_), rsum(size, window_), 0.0)
@op("quote")
def EffectiveSpread(): return 20000.0 * side * div(price - mid, mid)


@op("quote")
def RealizedSpread(horizon=20):
    p, m, s = lag(price, horizon), lag(mid, horizon), lag(side, horizon)
    return 20000.0 * s * div(p - mid, m)


@op("quote")
def KylesLambda(window_=20):
    d, q = mid - lag(mid), side * size
    return div(rcov(d, q, window_), rvar(both(q, d), window_), 0.0)


@op()
def Vpin(bucket_volume=5000.0, num_buckets=10):
    def make():
        from collections import deque

        done, buy, sell, total = deque(maxlen=num_buckets), 0.0, 0.0, 0.0

        def step(amount, way):
            nonlocal buy, sell, total
            left = amount
            whole = int(left // bucket_volume)
            while left > 0:
                take = min(left, bucket_volume - total)
                buy, sell = (buy + take, sell) if way > 0 else (buy, sell + take)
                total += take
                left -= take
                if total >= bucket_volume:
                    done.append(abs(buy - sell))
                    buy = sell = total = 0.0
                    if whole > 2 * num_buckets and left >= bucket_volume:
                        # the buckets in between are all one-sided
                        skip = int(left // bucket_volume)
                        done.extend([bucket_volume] * min(skip, num_buckets))
                        left -= skip * bucket_volume
            return sum(done) / (num_buckets * bucket_volume) if len(done) == num_buckets else None

        return step

    return scan(make, size, side, tag=(bucket_volume, num_buckets))


@op()
def AmihudIlliquidity(period=20):
    r = abs(div(price - lag(price), lag(price), 0.0))
    return ravg(div(r, price * size, 0.0), period)


@op()
def RollMeasure(period=20):
    def of(d):
        m, n = d.mean(), len(d)
        k = float(((d[:-1] - m) * (d[1:] - m)).sum()) / (n - 1) if n > 1 else 0.0
        return 2 * math.sqrt(-k) if k < 0 else 0.0

    return window(of, period, price - lag(price))


@op()
def TradeSignAutocorrelation(period=20): return ravg(side * lag(side), period - 1)
@op()
def Pin(window_=20): return abs(rsum(side, window_)) / float(window_)


@op("pair")
def HasbrouckInformationShare(period=20):
    a, b = rvar(col("x") - lag(col("x")), period), rvar(col("y") - lag(col("y")), period)
    return div(a, a + b, 0.5)


# Books are arrays of (price, size) from the best level on; these run in the Arrow kernel or as array functions.
BOOKS = {}


def book(f):
    BOOKS[f.__name__] = f
    return f


op = family("Market Breadth", "breadth")
adv, dec, up, down, total, members, highs, lows, above, signals = (col(k) for k in ("adv", "dec", "adv_volume", "dec_volume", "volume", "members", "highs", "lows", "above", "signals"))


@op()
def AdvanceDecline(): return csum(adv - dec)
@op()
def AdvanceDeclineRatio(): return div(adv, mx(dec, 1.0))
@op()
def AdVolumeLine(): return csum(up - down)


def mcclellan():
    net = div(adv - dec, adv + dec, 0.0) * 1000.0
    return ema(net, alpha=0.1) - ema(net, alpha=0.05)


@op()
def McClellanOscillator(): return mcclellan()
@op()
def McClellanSummationIndex(): return csum(mcclellan())
@op()
def Trin(): return div(div(adv, mx(dec, 1.0)), div(mx(up, 1.0), mx(down, 1.0)), 0.0)
@op()
def BreadthThrust(period=10): return ravg(div(adv, adv + dec, 0.5), period)
@op()
def NewHighsNewLows(): return highs - lows
@op()
def HighLowIndex(period=10): return ravg(div(100.0 * highs, highs + lows, 50.0), period)
@op()
def PercentAboveMa(): return div(100.0 * above, members)
@op()
def UpDownVolumeRatio(): return div(up, mx(down, 1.0))
@op()
def BullishPercentIndex(): return div(100.0 * signals, members)
@op()
def CumulativeVolumeIndex(): return csum(div(up - down, total, 0.0))
@op()
def AbsoluteBreadthIndex(): return abs(adv - dec)
@op()
def TickIndex(): return adv - dec
