"""Pivots, support and resistance, single-bar projections."""

from ..plans.expr import *  # noqa: F403
from .catalog import family
from .common import c, h, l, o, typical, v
from .volatility import centred

op = family("Pivots & S/R", "candle")
r = h - l


@op()
def ClassicPivots():
    p = typical
    return {"pp": p, "r1": 2.0 * p - l, "r2": p + r, "r3": h + 2.0 * (p - l), "s1": 2.0 * p - h, "s2": p - r, "s3": l - 2.0 * (h - p)}


@op()
def FibonacciPivots():
    p = typical
    return {"pp": p} | {f"r{i}": p + k * r for i, k in enumerate((0.382, 0.618, 1.0), 1)} | {f"s{i}": p - k * r for i, k in enumerate((0.382, 0.618, 1.0), 1)}


@op()
def Camarilla():
    k = {i: 1.1 / d for i, d in enumerate((12, 6, 4, 2), 1)}
    return {"pp": typical} | {f"r{i}": c + k[i] * r for i in k} | {f"s{i}": c - k[i] * r for i in k}


@op()
def WoodiePivots():
    p = (h + l + 2.0 * c) / 4.0
    return {"pp": p, "r1": 2.0 * p - l, "r2": p + r, "s1": 2.0 * p - h, "s2": p - r}


@op()
def DemarkPivots():
    s = cases(c < o, h + 2.0 * l + c, c > o, 2.0 * h + l + c, h + l + 2.0 * c)
    return {"pp": s / 4.0, "r1": s / 2.0 - l, "s1": s / 2.0 - h}


@op()
def WilliamsFractals(): return {"up": centred(h, 2, True), "down": centred(l, 2, False)}


@op()
def CentralPivotRange():
    b = (h + l) / 2.0
    return {"pivot": typical, "tc": 2.0 * typical - b, "bc": b}


@op()
def MurreyMathLines(period=64):
    a, b = rmax(h, period), rmin(l, period)
    return {f"mm{k}_8": b + (a - b) * (k / 8) for k in range(8, -1, -1)}


@op()
def VolumeWeightedSr(period=20):
    s = rsum(v, period)
    w = lambda z: where(s > 0.0, fn("div", rsum(z * v, period), s), ravg(z, period))
    return {"support": w(l), "resistance": w(h)}


def pivot(value, left, right, highest):
    m, ok = lag(value, right), None
    for i in range(left + right + 1):
        if i != right:
            t = m > lag(value, i) if highest else m < lag(value, i)
            ok = t if ok is None else ok & t
    return fill(only(ok, m))


@op()
def PivotReversal(left=2, right=2):
    a, b = pivot(h, left, right, True), pivot(l, left, right, False)
    p = lag(c)
    ready = lag(c, left + right) * 0.0
    up, down = fn("coalesce", where((p <= a) & (c > a), 1.0, 0.0), 0.0), fn("coalesce", where((p >= b) & (c < b), 1.0, 0.0), 0.0)
    return cases(eq(down, 1.0), -1.0, eq(up, 1.0), 1.0, 0.0) + ready


@op()
def ZigZag(threshold=0.05):
    def make():
        e, way = None, 1

        def step(a, b):
            nonlocal e, way
            if e is None:
                e = a
            elif way > 0:
                if a > e:
                    e = a
                elif b <= e * (1 - threshold):
                    out, e, way = (e, 1.0), b, -1
                    return out
            else:
                if b < e:
                    e = b
                elif a >= e * (1 + threshold):
                    out, e, way = (e, -1.0), a, 1
                    return out
            return None

        return step

    return picks(scan(make, h, l, outs=2, tag=threshold), "swing direction")
