"""Trailing stops and DeMark counts."""

import math

from ..plans.expr import *  # noqa: F403
from .catalog import family
from .common import atr, c, h, l, lag, o, true_range, v, x

op = family("Trailing Stops", "candle")


def parabolic(up_rates, down_rates, start=0.0, offset=0.0, signed=False):
    """Parabolic stop and reverse. The stop never passes the extremes of this and the previous bar before the test for a turn."""

    def make():
        sar = ep = ph = pl = None
        up, af = True, 0.0

        def step(hi, lo):
            nonlocal sar, ep, ph, pl, up, af
            if sar is None:
                up = start >= 0
                sar = abs(start) if start else lo
                ep, af = (hi, up_rates[0]) if up else (lo, down_rates[0])
                ph, pl = hi, lo
                return None
            s = sar + af * (ep - sar)
            s = min(s, pl, lo) if up else max(s, ph, hi)
            if lo <= s if up else hi >= s:
                s, up = ep, not up
                s += abs(s) * offset * (-1 if up else 1)
                ep, af = (hi, up_rates[0]) if up else (lo, down_rates[0])
            elif hi > ep if up else lo < ep:
                rates = up_rates if up else down_rates
                ep, af = (hi if up else lo), min(af + rates[1], rates[2])
            sar, ph, pl = s, hi, lo
            return s if up or not signed else -s

        return step

    return scan(make, h, l, tag=(up_rates, down_rates, start, offset, signed))


@op()
def Psar(af_start=0.02, af_step=0.02, af_max=0.20):
    r = (af_start, af_step, af_max)
    return parabolic(r, r)


@op()
def SarExt(start_value=0.0, offset_on_reverse=0.0, accel_init_long=0.02, accel_long=0.02, accel_max_long=0.20, accel_init_short=0.02, accel_short=0.02, accel_max_short=0.20):
    return parabolic((accel_init_long, accel_long, accel_max_long), (accel_init_short, accel_short, accel_max_short), start_value, offset_on_reverse, True)


@op()
def SuperTrend(atr_period=10, multiplier=3.0):
    def make():
        hi = lo = p = None
        way = 1.0

        def step(close, mid, band):
            nonlocal hi, lo, p, way
            a, b = mid + band, mid - band
            if p is not None:
                a = a if a < hi or p > hi else hi
                b = b if b > lo or p < lo else lo
                way = (-1.0 if close <= a else 1.0) if way < 0 else (1.0 if close >= b else -1.0)
            hi, lo, p = a, b, close
            return (lo if way > 0 else hi), way

        return step

    return picks(scan(make, c, (h + l) / 2.0, multiplier * atr(atr_period), outs=2), "value direction")


@op()
def ChandelierExit(period=22, multiplier=3.0):
    d = multiplier * atr(period)
    return {"long_stop": rmax(h, period) - d, "short_stop": rmin(l, period) + d}


@op()
def ChandeKrollStop(atr_period=10, atr_multiplier=1.0, stop_period=9):
    d = atr_multiplier * atr(atr_period)
    return {"stop_long": rmin(rmin(l, atr_period) + d, stop_period), "stop_short": rmax(rmax(h, atr_period) - d, stop_period)}


@op()
def AtrTrailingStop(atr_period=14, multiplier=3.0):
    def make():
        s = p = None

        def step(close, loss):
            nonlocal s, p
            if s is None:
                s = close - loss
            elif close > s:
                s = max(close - loss, s) if p > s else close - loss
            else:
                s = min(close + loss, s) if close < s and p < s else close + loss
            p = close
            return s

        return step

    return scan(make, c, multiplier * atr(atr_period), tag=())


@op()
def HiLoActivator(period=3):
    a, b = lag(ravg(h, period)), lag(ravg(l, period))
    side = fill(cases(c > a, 1.0, c < b, -1.0, only(eq(1.0, 0.0), c)))
    return where(fn("coalesce", side, 1.0) > 0.0, b, a)


@op()
def VoltyStop(atr_period=14, multiplier=2.0):
    def make():
        a, up = None, True

        def step(close, band):
            nonlocal a, up
            if a is None:
                a = close
            elif up:
                a, up = (close, False) if close < a - band else (max(a, close), True)
            else:
                a, up = (close, True) if close > a + band else (min(a, close), False)
            return a - band if up else a + band

        return step

    return scan(make, c, multiplier * atr(atr_period))


@op()
def YoyoExit(atr_period=14, multiplier=2.0):
    def make():
        t, held = None, True

        def step(close, band):
            nonlocal t, held
            if t is None:
                t = close - band
            elif held:
                if close < t:
                    held = False
                else:
                    t = max(t, close - band)
            elif close > t + band:
                t, held = close - band, True
            return t

        return step

    return scan(make, c, multiplier * atr(atr_period))


@op()
def DonchianStop(period=10): return {"stop_long": rmin(l, period), "stop_short": rmax(h, period)}


def ratchet(below, above, tag):
    """A stop at below(x) that only rises while long, at above(x) that only falls while short; a close through it turns."""

    def make():
        s, up = None, True

        def step(a):
            nonlocal s, up
            if s is None:
                s = below(a)
            elif up:
                s, up = (above(a), False) if a < s else (max(s, below(a)), True)
            else:
                s, up = (below(a), True) if a > s else (min(s, above(a)), False)
            return s

        return step

    return scan(make, x, tag=tag)


@op("x")
def PercentageTrailingStop(percent=5.0):
    k = percent / 100
    return ratchet(lambda a: a - abs(a) * k, lambda a: a + abs(a) * k, ("percent", percent))


@op("x")
def StepTrailingStop(step_size=1.0):
    z = step_size
    return ratchet(lambda a: (math.floor(a / z) - 1) * z, lambda a: (math.ceil(a / z) + 1) * z, ("step", z))


@op("x")
def RenkoTrailingStop(block_size=1.0):
    z = block_size

    def make():
        a, up = None, True

        def step(p):
            nonlocal a, up
            if a is None:
                a = p
            elif up:
                a, up = (p, False) if p < a - z else (a + max(0, math.floor((p - a) / z)) * z, True)
            else:
                a, up = (p, True) if p > a + z else (a - max(0, math.floor((a - p) / z)) * z, False)
            return a - z if up else a + z

        return step

    return scan(make, x, tag=z)


def turning(*xs, long, short, rise=None, fall=None, first=None, tag=()):
    """(stop, direction): new stops from long(row) and short(row); rise and fall move a standing stop before the close is tested."""

    def make():
        s, way, mem = 0.0, 0.0, [None]

        def step(*row):
            nonlocal s, way
            if way == 0:
                way = first(row) if first else 1.0
                s = long(row, mem, True) if way > 0 else short(row, mem, True)
            elif way > 0:
                s = rise(s, row) if rise else max(s, long(row, mem, False))
                if row[0] < s:
                    way, s = -1.0, short(row, mem, True)
            else:
                s = fall(s, row) if fall else min(s, short(row, mem, False))
                if row[0] > s:
                    way, s = 1.0, long(row, mem, True)
            return s, way

        return step

    return picks(scan(make, *xs, outs=2, tag=tag), "value direction")


@op()
def KaseDevStop(period=30, dev=1.0):
    d = mx(h, lag(h)) - mn(l, lag(l))
    band = ravg(d, period) + dev * rstds(d, period)

    def long(r, mem, new):
        mem[0] = r[1] if new else max(mem[0], r[1])
        return mem[0] - r[3]

    def short(r, mem, new):
        mem[0] = r[2] if new else min(mem[0], r[2])
        return mem[0] + r[3]

    return turning(c, h, l, band, long=long, short=short, tag=("kase", period, dev))


@op()
def ElderSafeZone(period=14, coeff=2.0):
    mean = lambda z: div(rsum(z, period), rsum(where(z > 0.0, 1.0, 0.0), period), 0.0)
    down, up = mean(mx(lag(l) - l, 0.0)), mean(mx(h - lag(h), 0.0))
    return turning(c, l - coeff * down, h + coeff * up, long=lambda r, m, n: r[1], short=lambda r, m, n: r[2], tag=("elder", period, coeff))


@op()
def AtrRatchet(atr_period=14, start_mult=4.0, increment=0.1):
    return turning(
        c, atr(atr_period), long=lambda r, m, n: r[0] - start_mult * r[1], short=lambda r, m, n: r[0] + start_mult * r[1],
        rise=lambda s, r: s + increment * r[1], fall=lambda s, r: s - increment * r[1], tag=("ratchet", atr_period, start_mult, increment),
    )


@op()
def Nrtr(pct=2.0):
    k = pct / 100

    def make():
        w, way = None, 1.0

        def step(a):
            nonlocal w, way
            if w is None:
                w = a
            elif way > 0:
                w = max(w, a)
                if a < w * (1 - k):
                    w, way = a, -1.0
            else:
                w = min(w, a)
                if a > w * (1 + k):
                    w, way = a, 1.0
            return w * (1 - k * way), way

        return step

    return picks(scan(make, c, outs=2, tag=pct), "value direction")


@op()
def TimeBasedStop(max_bars=5): return mn(csum(both(1.0, c)) / float(max_bars), 1.0)


@op()
def ModifiedMaStop(period=14):
    return turning(c, rma(c, period), long=lambda r, m, n: r[1], short=lambda r, m, n: r[1], first=lambda r: 1.0 if r[0] >= r[1] else -1.0, tag=("ma", period))


op = family("DeMark", "candle")


def setup_of(lookback, target, ready=0.0):
    """Signed run length of closes below (+) or above (-) the close ``lookback`` bars ago, capped at ``target``."""

    def make():
        k = 0

        def step(a, b):
            nonlocal k
            k = min(max(k, 0) + 1, target) if a < b else max(min(k, 0) - 1, -target) if a > b else 0
            return float(k)

        return step

    return scan(make, c + ready, lag(c, lookback), tag=("setup", lookback, target))


@op()
def TdSetup(lookback=4, target=9): return setup_of(lookback, target)


def countdown_of(setup_lookback, setup_target, countdown_lookback, countdown_target, combo):
    """Signed count of bars that qualify since a completed setup gave the direction, and the direction."""

    def make():
        way, n = 0, 0

        def step(k, a, low, high, this_low, this_high, p_low, p_high, p):
            nonlocal way, n
            done = 1 if k >= setup_target else -1 if k <= -setup_target else 0
            if done and done != way:
                way, n = done, 0
            ok = (a <= low if way > 0 else a >= high) if way else False
            if ok and combo:
                ok = this_low <= p_low and a < p if way > 0 else this_high >= p_high and a > p
            if ok and n < countdown_target:
                n += 1
            return float(n * way), float(way)

        return step

    ready = lag(c, max(setup_lookback, countdown_lookback)) * 0.0
    s = setup_of(setup_lookback, setup_target, ready)
    args = (s, c, lag(l, countdown_lookback), lag(h, countdown_lookback), l, h, lag(l), lag(h), lag(c))
    return s, scan(make, *(z + ready for z in args), outs=2, tag=(setup_target, countdown_target, combo))


@op()
def TdSequential(setup_lookback=4, setup_target=9, countdown_lookback=2, countdown_target=13):
    s, k = countdown_of(setup_lookback, setup_target, countdown_lookback, countdown_target, False)
    return {"setup": s, "countdown": pick(k, 0), "direction": pick(k, 1)}


@op()
def TdDeMarker(period=14):
    a, b = rsum(mx(h - lag(h), 0.0), period), rsum(mx(lag(l) - l, 0.0), period)
    return div(a, a + b, 0.5)


@op()
def TdRei(period=5):
    a, b = h - lag(h, 2), l - lag(l, 2)
    ok = ((h >= lag(l, 5)) | (h >= lag(l, 6))) & ((l <= lag(h, 5)) | (l <= lag(h, 6)))
    return div(100.0 * rsum(where(ok, a + b, 0.0), period), rsum(both(abs(a) + abs(b), where(ok, 1.0, 0.0)), period), 0.0)


@op()
def TdPressure(period=5): return div(100.0 * ravg(div(c - o, h - l, 0.0) * v, period), ravg(v, period), 0.0)


@op()
def TdCombo(setup_lookback=4, setup_target=9, countdown_lookback=2, countdown_target=13):
    return pick(countdown_of(setup_lookback, setup_target, countdown_lookback, countdown_target, True)[1], 0)


@op()
def TdCountdown(setup_lookback=4, setup_target=9, countdown_lookback=2, countdown_target=13):
    return pick(countdown_of(setup_lookback, setup_target, countdown_lookback, countdown_target, False)[1], 0)


def run_levels(lookback, target, names, buy_level, sell_level, tag):
    """Levels of completed setup runs; each stays until the next run of its side. mem holds the run's extreme row."""

    def make():
        k, buy, sell, mem = 0, None, None, None

        def step(a, b, hi, lo, tr):
            nonlocal k, buy, sell, mem
            way = 1 if a < b else -1 if a > b else 0
            if way == 0:
                k, mem = 0, None
            else:
                if k * way <= 0:
                    k, mem = 0, None
                k = way * min(abs(k) + 1, target)
                if way > 0:
                    mem = buy_level(mem, hi, lo, tr)
                    if k == target:
                        buy = mem[1]
                else:
                    mem = sell_level(mem, hi, lo, tr)
                    if -k == target:
                        sell = mem[1]
            if buy is None and sell is None:
                return None
            return NAN if buy is None else buy, NAN if sell is None else sell

        return step

    return picks(scan(make, c, lag(c, lookback), h, l, true_range(), outs=2, tag=(tag, lookback, target)), names)


NAN = float("nan")


@op()
def TdLines(lookback=4, target=9):
    top = lambda m, hi, lo, tr: (0, hi if m is None else max(m[1], hi))
    low = lambda m, hi, lo, tr: (0, lo if m is None else min(m[1], lo))
    return run_levels(lookback, target, "resistance support", top, low, "lines")


@op()
def TdRiskLevel(lookback=4, target=9):
    buy = lambda m, hi, lo, tr: m if m is not None and m[0] <= lo else (lo, lo - tr)
    sell = lambda m, hi, lo, tr: m if m is not None and m[0] >= hi else (hi, hi + tr)
    return run_levels(lookback, target, "buy_risk sell_risk", buy, sell, "risk")


@op()
def TdRangeProjection():
    s = cases(c < o, h + 2.0 * l + c, c > o, 2.0 * h + l + c, h + l + 2.0 * c)
    return {"high": s / 2.0 - l, "low": s / 2.0 - h}


def signal(bull, bear): return cases(bull, 1.0, bear, -1.0, 0.0)


po, ph, pl, pc = lag(o), lag(h), lag(l), lag(c)


@op()
def TdDifferential():
    return signal((c < pc) & ((c - l) > (pc - pl)) & ((h - c) < (ph - pc)), (c > pc) & ((h - c) > (ph - pc)) & ((c - l) < (pc - pl)))


@op()
def TdOpen(): return signal((o < pl) & (h > pl), (o > ph) & (l < ph))
@op()
def TdCamouflage(): return signal((c < pc) & (c > o) & (l < pl), (c > pc) & (c < o) & (h > ph))
@op()
def TdClop(): return signal((o < po) & (o < pc) & (c > po) & (c > pc), (o > po) & (o > pc) & (c < po) & (c < pc))


@op()
def TdClopwin():
    a, b = mn(po, pc), mx(po, pc)
    k = (o >= a) & (o <= b) & (c >= a) & (c <= b)
    return signal(k & (c >= o), k & (c < o))


@op()
def TdPropulsion(): return signal((o >= pc) & (c > ph), (o <= pc) & (c < pl))


@op()
def TdTrap():
    k = (ph < lag(h, 2)) & (pl > lag(l, 2))
    return signal(k & (c > ph), k & (c < pl))


@op()
def TdMovingAverage(period_st1=5, period_st2=13):
    m = (h + l) / 2.0
    b = ravg(m, period_st2)
    return {"st1": ravg(m, period_st1) + 0.0 * b, "st2": b}
