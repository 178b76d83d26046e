"""Market profile: volume and time by price over a rolling window of bars."""

import numpy as np

from ..plans.expr import *  # noqa: F403
from .catalog import family
from .common import c, h, l, v

op = family("Market Profile", "candle")


def histogram(hi, lo, weight, bins):
    """Lowest price, bin width and weight by bin; a bar's weight is shared by the bins it touches."""
    a, b = float(lo.min()), float(hi.max())
    out = np.zeros(bins)
    if b <= a:
        out[0] = weight.sum()
        return a, 0.0, out
    w = (b - a) / bins
    i = np.clip(np.floor((lo - a) / w), 0, bins - 1).astype(int)
    j = np.clip(np.floor((hi - a) / w), 0, bins - 1).astype(int)
    for p, q, z in zip(i, j, weight, strict=True):
        if z:
            out[p : q + 1] += z / (q - p + 1)
    return a, w, out


def area(hi, lo, vol, bins, share):
    """Point of control and the value area, grown from it toward the heavier neighbour, upward on ties."""
    a, w, z = histogram(hi, lo, vol, bins)
    if not w:
        return a, a, a
    p = int(z.argmax())
    i = j = p
    got, want = z[p], z.sum() * share
    while got < want and (i > 0 or j + 1 < bins):
        up = z[j + 1] if j + 1 < bins else -np.inf
        down = z[i - 1] if i > 0 else -np.inf
        if up >= down:
            j, got = j + 1, got + up
        else:
            i, got = i - 1, got + down
    return a + w * (p + 0.5), a + w * (j + 1), a + w * i


def value_area(n, bins, share):
    return picks(window(lambda hi, lo, vol: area(hi, lo, vol, bins, share), n, h, l, v, outs=3, tag=("area", bins, share)), "poc vah val")


@op()
def ValueArea(period=20, bin_count=50, value_area_pct=0.70): return value_area(period, bin_count, value_area_pct)
@op()
def CompositeProfile(period=20, bins=24, value_area_pct=0.70): return value_area(period, bins, value_area_pct)


def first_bars(n):
    """Running high and low of the first n rows, then held."""
    k = csum(both(1.0, c))
    return cmax(fn("coalesce", only(where(k <= float(n), 1.0, 0.0), h), -1e300)), cmin(fn("coalesce", only(where(k <= float(n), 1.0, 0.0), l), 1e300))


@op()
def InitialBalance(period=12): return dict(zip(("high", "low"), first_bars(period), strict=True))


@op()
def OpeningRange(period=6):
    a, b = first_bars(period)
    return {"high": a, "low": b, "breakout_distance": cases(c > a, c - a, c < b, c - b, 0.0)}


def profile(n, bins, touches):
    def of(hi, lo, vol):
        if touches:
            a, w, z = touch_counts(hi, lo, bins)
        else:
            a, w, z = histogram(hi, lo, vol, bins)
        return (a, a + w * bins, *z)

    w = window(of, n, h, l, v, outs=2 + bins, tag=("profile", bins, touches))
    return {"price_low": pick(w, 0), "price_high": where(eq(pick(w, 1), pick(w, 0)), pick(w, 0), rmax(h, n)), ("counts" if touches else "bins"): [pick(w, 2 + i) for i in range(bins)]}


def touch_counts(hi, lo, bins):
    a, b = float(lo.min()), float(hi.max())
    out = np.zeros(bins)
    if b <= a:
        out[0] = len(hi)
        return a, 0.0, out
    w = (b - a) / bins
    for p, q in zip(np.clip(np.floor((lo - a) / w), 0, bins - 1).astype(int), np.clip(np.floor((hi - a) / w), 0, bins - 1).astype(int), strict=True):
        out[p : q + 1] += 1
    return a, w, out


@op()
def VolumeProfile(period=20, bin_count=50): return profile(period, bin_count, False)
@op()
def TpoProfile(period=30, bin_count=50): return profile(period, bin_count, True)


@op()
def NakedPoc(session_len=20, bins=24):
    def make():
        naked, session = [], []

        def step(hi, lo, close, vol):
            nonlocal naked, session
            naked = [p for p in naked if not lo <= p <= hi]
            session.append((hi, lo, vol))
            if len(session) == session_len:
                a, w, z = histogram(*np.array(session).T, bins)
                naked.append(a + w * (int(z.argmax()) + 0.5) if w else a)
                session = []
                step.ready = True
            return (min(naked, key=lambda p: abs(p - close)) if naked else close) if step.ready else None

        step.ready = False
        return step

    return scan(make, h, l, c, v, tag=(session_len, bins))


@op()
def SinglePrints(period=20, bins=24):
    def of(hi, lo):
        _, w, z = touch_counts(hi, lo, bins)
        return float((z == 1).sum()) if w else 0.0

    return window(of, period, h, l, tag=bins)


@op()
def ProfileShape(period=20, bins=24):
    def of(hi, lo, vol):
        _, w, z = histogram(hi, lo, vol, bins)
        p = int(z.argmax()) if w else 0
        return 1.0 if p >= bins - bins // 3 else -1.0 if p < bins // 3 else 0.0

    return window(of, period, h, l, v, tag=bins)


@op()
def HighLowVolumeNodes(period=20, bins=24):
    def of(hi, lo, vol):
        a, w, z = histogram(hi, lo, vol, bins)
        p = int(z.argmax())
        q = int(np.where(z > 0, z, np.inf).argmin()) if (z > 0).any() else p
        return a + (p + 0.5) * w, a + (q + 0.5) * w

    return picks(window(of, period, h, l, v, outs=2, tag=bins), "hvn lvn")
