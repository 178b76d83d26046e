"""Seasonality and sessions; ts is in epoch milliseconds, the local day is a fixed offset from UTC."""

import calendar

import numpy as np

from ..plans.expr import *  # noqa: F403
from .catalog import family
from .common import c, h, l, o, ts, typical, v

op = family("Seasonality & Session", "timed")
DAY = 86_400_000.0


def local(offset): return ts + 60_000.0 * offset
def day(offset): return fn("floor", local(offset) / DAY)
def minute(offset): return fn("floor", (local(offset) - DAY * day(offset)) / 60_000.0)


def per_day(offset, f, *xs, outs=1, tag=()):
    """f(state, new day?, *row) over rows; state is a dict that f keeps."""

    def make():
        s, d = {}, None

        def step(k, *row):
            nonlocal d
            new, d = k != d, k
            return f(s, new, *row)

        return step

    return scan(make, day(offset), *xs, outs=outs, tag=(f.__qualname__, tag))


@op()
def SessionVwap(utc_offset_minutes=0):
    def f(s, new, price, vol):
        if new:
            s["a"] = s["b"] = 0.0
        s["a"] += price * vol
        s["b"] += vol
        return s["a"] / s["b"] if s["b"] > 0 else price

    return per_day(utc_offset_minutes, f, typical, v)


@op()
def SessionHighLow(utc_offset_minutes=0):
    def f(s, new, hi, lo):
        s["h"], s["l"] = (hi, lo) if new else (max(s["h"], hi), min(s["l"], lo))
        return s["h"], s["l"]

    return picks(per_day(utc_offset_minutes, f, h, l, outs=2), "high low")


@op()
def SessionRange(utc_offset_minutes=0):
    def f(s, new, hi, lo, m):
        if new:
            s["x"] = [None] * 3
        k = int(m // 480)
        e = s["x"][k]
        s["x"][k] = (hi, lo) if e is None else (max(e[0], hi), min(e[1], lo))
        return tuple(0.0 if e is None else e[0] - e[1] for e in s["x"])

    return picks(per_day(utc_offset_minutes, f, h, l, minute(utc_offset_minutes), outs=3), "asia eu us")


@op()
def AverageDailyRange(period=14, utc_offset_minutes=0):
    def f(s, new, hi, lo):
        if new:
            if "h" in s:
                s["done"] = [*s.get("done", []), s["h"] - s["l"]][-period:]
            s["h"], s["l"] = hi, lo
        s["h"], s["l"] = max(s["h"], hi), min(s["l"], lo)
        z = s.get("done", [])
        return sum(z) / period if len(z) == period else None

    return per_day(utc_offset_minutes, f, h, l, tag=period)


def gap_of(s, new, a, close):
    if new and "p" in s:
        s["gap"] = a / s["p"] - 1 if s["p"] else 0.0
    if new:
        s["o"] = a
    s["p"] = close
    return s.get("gap")


@op()
def OvernightGap(utc_offset_minutes=0): return per_day(utc_offset_minutes, gap_of, o, c)


@op()
def OvernightIntradayReturn(utc_offset_minutes=0):
    def f(s, new, a, close):
        g = gap_of(s, new, a, close)
        return None if g is None else (g, close / s["o"] - 1 if s["o"] else 0.0)

    return picks(per_day(utc_offset_minutes, f, o, c, outs=2), "overnight intraday")


@op()
def TurnOfMonth(n_first=3, n_last=1, utc_offset_minutes=0):
    def f(s, new, d, close):
        if new and "c" in s:
            date = np.datetime64(int(s["d"]), "D").astype(object)
            if "p" in s:
                r = s["c"] / s["p"] - 1 if s["p"] else 0.0
                if date.day <= n_first or date.day > calendar.monthrange(date.year, date.month)[1] - n_last:
                    s["sum"], s["n"] = s.get("sum", 0.0) + r, s.get("n", 0) + 1
            s["p"] = s["c"]
        s["c"], s["d"] = close, d
        return s["sum"] / s["n"] if s.get("n") else None

    return per_day(utc_offset_minutes, f, day(utc_offset_minutes), c, tag=(n_first, n_last))


ret = div(c, lag(c), 1.0) - 1.0


@op()
def SeasonalZScore(utc_offset_minutes=0):
    def make():
        seen = {}

        def step(m, r):
            k = int(m // 60)
            n, mean, m2 = seen.get(k, (0, 0.0, 0.0))
            sd = (m2 / (n - 1)) ** 0.5 if n > 1 else None
            d = r - mean
            seen[k] = (n + 1, mean + d / (n + 1), m2 + d * (r - mean - d / (n + 1)))
            return None if sd is None else (r - mean) / sd if sd > 0 else 0.0

        return step

    return scan(make, minute(utc_offset_minutes), ret, tag="season")


def by_bucket(bucket, value, n, stat):
    """Vector of a running statistic of each bucket, as of every row."""

    def make():
        k, mean, m2 = np.zeros(n), np.zeros(n), np.zeros(n)

        def step(b, a):
            i = int(b)
            k[i] += 1
            d = a - mean[i]
            mean[i] += d / k[i]
            m2[i] += d * (a - mean[i])
            return tuple(mean if stat == "mean" else np.sqrt(np.where(k > 1, m2 / np.maximum(k - 1, 1), 0.0)))

        return step

    s = scan(make, bucket, value, outs=n, tag=("bucket", n, stat))
    return {"bins": [pick(s, i) for i in range(n)]}


def time_bucket(n, offset): return mn(fn("floor", minute(offset) * float(n) / 1440.0), float(n - 1))


@op()
def TimeOfDayReturnProfile(buckets=24, utc_offset_minutes=0): return by_bucket(time_bucket(buckets, utc_offset_minutes), ret, buckets, "mean")


@op()
def DayOfWeekProfile(utc_offset_minutes=0):
    d = day(utc_offset_minutes) + 3.0
    return by_bucket(d - 7.0 * fn("floor", d / 7.0), ret, 7, "mean")


@op()
def IntradayVolatilityProfile(buckets=24, utc_offset_minutes=0): return by_bucket(time_bucket(buckets, utc_offset_minutes), ret, buckets, "std")
@op()
def VolumeByTimeProfile(buckets=24, utc_offset_minutes=0): return by_bucket(time_bucket(buckets, utc_offset_minutes), v, buckets, "mean")


