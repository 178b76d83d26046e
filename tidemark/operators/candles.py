"""Candlestick patterns: +1 bullish, -1 bearish, 0 none; missing until the earlier bars are there."""

from ..plans.expr import *  # noqa: F403
from .catalog import family
from .common import c, h, l, o

op = family("Candlestick Patterns", "candle")


class Bar:
    """The bar k rows ago."""

    def __init__(self, k: int):
        self.o, self.h, self.l, self.c = (lag(z, k) for z in (o, h, l, c))
        self.range, self.body = self.h - self.l, self.c - self.o
        self.size = abs(self.body)
        self.top, self.bottom = mx(self.o, self.c), mn(self.o, self.c)
        self.upper, self.lower = self.h - self.top, self.bottom - self.l
        self.white, self.black = self.c > self.o, self.c < self.o
        self.mid = (self.o + self.c) / 2.0
        self.real = self.range > 0.0

    def doji(self, part=0.1): return self.real & (self.size <= part * self.range)
    def long(self, part=0.5): return self.size >= part * self.range
    def marubozu(self): return self.real & self.long(0.95)


B0, B1, B2, B3, B4 = (Bar(k) for k in range(5))


def every(*conds):
    out = conds[0]
    for z in conds[1:]:
        out = out & z
    return out


def pattern(bull=None, bear=None, bars=1):
    """+1 / -1 / 0, missing for the first bars - 1 rows."""
    out = node(0.0)
    if bear is not None:
        out = where(bear, -1.0, out)
    if bull is not None:
        out = where(bull, 1.0, out)
    return out + 0.0 * lag(c, bars - 1)


def inside(z, a, b): return (z >= a) & (z <= b)


@op()
def Doji(signed=False, body_threshold=0.1):
    d = B0.doji(body_threshold)
    if not signed:
        return pattern(d)
    at = div(B0.mid - l, B0.range)
    return pattern(d & (at > 2 / 3), d & (at < 1 / 3))


hammer = every(B0.real, B0.size > 0.0, B0.lower >= 2.0 * B0.size, B0.upper <= B0.size)
inverted = every(B0.real, B0.size > 0.0, B0.upper >= 2.0 * B0.size, B0.lower <= B0.size)


@op()
def Hammer(): return pattern(hammer)
@op()
def InvertedHammer(): return pattern(inverted)
@op()
def HangingMan(): return pattern(None, hammer)
@op()
def ShootingStar(): return pattern(None, inverted)


def engulfs(a, b):
    """Bar b's body around the opposite body of bar a: (bullish, bearish)."""
    k = (a.size > 0.0) & (b.size > a.size)
    return every(k, a.black, b.white, b.o <= a.c, b.c >= a.o), every(k, a.white, b.black, b.o >= a.c, b.c <= a.o)


def within(a, b):
    k = every(a.size > 0.0, b.size > 0.0, b.size < a.size)
    return every(k, a.black, b.white, b.o >= a.c, b.c <= a.o), every(k, a.white, b.black, b.o <= a.c, b.c >= a.o)


@op()
def Engulfing(): return pattern(*engulfs(B1, B0), 2)
@op()
def Harami(): return pattern(*within(B1, B0), 2)


@op()
def MorningEveningStar():
    k = every(B2.size > 0.0, B0.size > 0.0, B2.size >= 2.0 * B1.size, B0.size >= 2.0 * B1.size)
    return pattern(every(k, B2.black, B0.white, c > B2.mid), every(k, B2.white, B0.black, c < B2.mid), 3)


def marching(*bars):
    """Each bar opens in the body before and closes beyond it: (up, down)."""
    up, down = [b.white for b in bars], [b.black for b in bars]
    for a, b in zip(bars, bars[1:]):  # noqa: B905
        up += [b.c > a.c, inside(b.o, a.o, a.c)]
        down += [b.c < a.c, inside(b.o, a.c, a.o)]
    return every(*up), every(*down)


@op()
def ThreeSoldiersOrCrows(): return pattern(*marching(B2, B1, B0), 3)


@op()
def PiercingDarkCloud():
    return pattern(every(B1.black, B0.white, o < B1.l, c > B1.mid, c < B1.o), every(B1.white, B0.black, o > B1.h, c < B1.mid, c > B1.o), 2)


@op()
def Marubozu(shadow_tolerance=0.05):
    k = every(B0.real, B0.upper <= shadow_tolerance * B0.range, B0.lower <= shadow_tolerance * B0.range)
    return pattern(k & B0.white, k & B0.black)


@op()
def Tweezer(tolerance=0.001):
    same = lambda a, b: abs(a - b) <= tolerance * mx(abs(a), abs(b))
    low = same(l, B1.l)
    return pattern(low, ~low & same(h, B1.h), 2)


@op()
def SpinningTop(body_threshold=0.3):
    k = every(B0.real, B0.size > 0.0, B0.size <= body_threshold * B0.range, B0.upper >= 2.0 * B0.size, B0.lower >= 2.0 * B0.size)
    return pattern(k & B0.white, k & B0.black)


@op()
def ThreeInside():
    up, down = within(B2, B1)
    return pattern(every(up, B0.white, c > B2.o), every(down, B0.black, c < B2.o), 3)


@op()
def ThreeOutside():
    up, down = engulfs(B2, B1)
    return pattern(every(up, B0.white, c > B1.c), every(down, B0.black, c < B1.c), 3)


@op()
def TwoCrows():
    return pattern(None, every(B2.white, B1.black, B1.c > B2.c, B0.black, o < B1.o, o > B1.c, c > B2.o, c < B2.c), 3)


@op()
def UpsideGapTwoCrows():
    return pattern(None, every(B2.white, B1.black, B1.c > B2.c, B0.black, o > B1.o, c < B1.c, c > B2.c), 3)


@op()
def IdenticalThreeCrows(tolerance=0.001):
    same = lambda a, b: abs(a - b) <= tolerance * mx(abs(a), abs(b))
    return pattern(None, every(B2.black, B1.black, B0.black, B1.c < B2.c, c < B1.c, same(B1.o, B2.c), same(o, B1.c)), 3)


@op()
def ThreeLineStrike():
    up, down = marching(B3, B2, B1)
    return pattern(every(up, B0.black, o > B1.c, c < B3.o), every(down, B0.white, o < B1.c, c > B3.o), 4)


@op()
def ThreeStarsInSouth(tolerance=0.001):
    tol = tolerance * mx(abs(h), abs(l))
    return pattern(every(B2.black, B1.black, B0.black, B2.c - B2.l >= B2.size, inside(B1.o, B2.c, B2.o), B1.l > B2.l, B1.c > B2.c, B1.size < B2.size, h - o <= tol, c - l <= tol, h < B1.h, l > B1.l), None, 3)


@op()
def AbandonedBaby(tolerance=0.001):
    k = B1.size <= tolerance * mx(abs(B1.o), abs(B1.c))
    return pattern(every(k, B2.black, B1.h < B2.l, B0.white, l > B1.h), every(k, B2.white, B1.l > B2.h, B0.black, h < B1.l), 3)


@op()
def AdvanceBlock():
    up, _ = marching(B2, B1, B0)
    return pattern(None, every(up, B1.size < B2.size, B0.size < B1.size, B0.upper >= B1.upper, B0.upper > 0.0), 3)


@op()
def BeltHold(shadow_tolerance=0.05):
    k = B0.real & B0.long()
    return pattern(every(k, B0.white, o - l <= shadow_tolerance * B0.range), every(k, B0.black, h - o <= shadow_tolerance * B0.range))


@op()
def Breakaway():
    down = every(B4.black, B3.black, B3.o < B4.c, B2.h < B3.h, B2.l < B3.l, B1.black, B1.h < B2.h, B1.l < B2.l, B0.white, c > B3.o, c < B4.c)
    up = every(B4.white, B3.white, B3.o > B4.c, B2.h > B3.h, B2.l > B3.l, B1.white, B1.h > B2.h, B1.l > B2.l, B0.black, c < B3.o, c > B4.c)
    return pattern(down, up, 5)


@op()
def Counterattack(equal_tolerance=0.05):
    k = every(B1.long(), B0.long(), abs(c - B1.c) <= equal_tolerance * 0.5 * (B1.range + B0.range))
    return pattern(every(k, B1.black, B0.white), every(k, B1.white, B0.black), 2)


@op()
def DojiStar():
    k = every(B1.real, B1.long(), B0.doji())
    return pattern(every(k, B1.black, B0.top < B1.c), every(k, B1.white, B0.bottom > B1.c), 2)


@op()
def DragonflyDoji(): return pattern(every(B0.doji(), B0.upper <= 0.1 * B0.range, B0.lower >= 0.5 * B0.range))
@op()
def GravestoneDoji(): return pattern(None, every(B0.doji(), B0.lower <= 0.1 * B0.range, B0.upper >= 0.5 * B0.range))


legs = every(B0.doji(), B0.upper >= 0.3 * B0.range, B0.lower >= 0.3 * B0.range)


@op()
def LongLeggedDoji(): return pattern(legs)
@op()
def RickshawMan(): return pattern(legs & inside(div(B0.mid - l, B0.range), 0.4, 0.6))


@op()
def EveningDojiStar(penetration=0.3):
    return pattern(None, every(B2.real, B2.body >= 0.5 * B2.range, B1.doji(), B1.bottom > B2.c, B0.black, B0.top < B1.bottom, c < B2.c - penetration * B2.body), 3)


@op()
def MorningDojiStar(penetration=0.3):
    return pattern(every(B2.real, -B2.body >= 0.5 * B2.range, B1.doji(), B1.top < B2.c, B0.white, B0.bottom > B1.top, c > B2.c + penetration * B2.size), None, 3)


@op()
def GapSideBySideWhite():
    k = every(B1.real, B1.white, B0.white, abs(o - B1.o) <= 0.1 * B1.range, B1.body <= 2.0 * B0.body, B0.body <= 2.0 * B1.body)
    return pattern(k & (B1.bottom > B2.top), k & (B1.top < B2.bottom), 3)


@op()
def HighWave(): return pattern(every(B0.real, B0.upper >= 0.4 * B0.range, B0.lower >= 0.4 * B0.range))


inner = (B1.h < B2.h) & (B1.l > B2.l)


@op()
def Hikkake(): return pattern(every(inner, h < B1.h, l < B1.l), every(inner, h > B1.h, l > B1.l), 3)
@op()
def HikkakeModified(): return pattern(every(inner, h < B1.h, l < B1.l, c > B1.l), every(inner, h > B1.h, l > B1.l, c < B1.h), 3)
@op()
def HomingPigeon(): return pattern(every(B1.black, B0.black, o <= B1.o, c >= B1.c, B0.size < B1.size), None, 2)


neck = every(B1.real, B1.black, B1.long(), B0.white, o < B1.l)


@op()
def OnNeck(): return pattern(None, neck & (abs(c - B1.l) <= 0.05 * B1.range), 2)
@op()
def InNeck(): return pattern(None, neck & inside(c, B1.c, B1.c + 0.1 * B1.size), 2)
@op()
def Thrusting(): return pattern(None, every(neck, c > B1.c + 0.1 * B1.size, c < B1.mid), 2)


@op()
def SeparatingLines():
    k = every(B1.real, B0.real, abs(o - B1.o) <= 0.05 * B1.range, B0.long())
    return pattern(every(k, B1.black, B0.white, o - l <= 0.05 * B0.range), every(k, B1.white, B0.black, h - o <= 0.05 * B0.range), 2)


kick = B1.marubozu() & B0.marubozu()
kick_up, kick_down = every(kick, B1.black, B0.white, l > B1.h), every(kick, B1.white, B0.black, h < B1.l)


@op()
def Kicking(): return pattern(kick_up, kick_down, 2)


@op()
def KickingByLength():
    longer = where(B1.size >= B0.size, B1.body, B0.body) > 0.0
    k = kick_up | kick_down
    return pattern(k & longer, k & ~longer, 2)


@op()
def LadderBottom():
    return pattern(every(B4.black, B3.black, B2.black, B3.o < B4.o, B3.c < B4.c, B2.o < B3.o, B2.c < B3.c, B1.black, B1.h > B1.o, B0.white, o > B1.o), None, 5)


@op()
def MatHold(penetration=0.5):
    small = [b.size <= 0.5 * B4.body for b in (B3, B2, B1)]
    return pattern(every(B4.real, B4.body >= 0.5 * B4.range, *small, B3.bottom > B4.c, mn(B3.l, B2.l, B1.l) > B4.c - penetration * B4.body, B0.white, c > mx(B4.h, B3.h, B2.h, B1.h)), None, 5)


@op()
def MatchingLow(): return pattern(every(B1.black, B0.black, abs(c - B1.c) <= 0.025 * (B1.range + B0.range)), None, 2)


@op()
def LongLine(period=5):
    k = (B0.range > lag(ravg(B0.range, period))) & B0.long()
    return pattern(k & (B0.body > 0.0), k & (B0.body <= 0.0)) + 0.0 * lag(ravg(B0.range, period))


@op()
def ShortLine(period=5):
    k = (B0.range < lag(ravg(B0.range, period))) & B0.long()
    return pattern(k & (B0.body > 0.0), k & (B0.body <= 0.0)) + 0.0 * lag(ravg(B0.range, period))


def three_methods(up):
    first = B4.body if up else -B4.body
    k = [B4.real, first >= 0.5 * B4.range]
    for b in (B3, B2, B1):
        k += [b.size < first, b.h <= B4.h, b.l >= B4.l]
    return every(*k, B0.white if up else B0.black, c > B4.c if up else c < B4.c)


@op()
def RisingThreeMethods(): return pattern(three_methods(True), None, 5)
@op()
def FallingThreeMethods(): return pattern(None, three_methods(False), 5)


@op()
def UpsideGapThreeMethods():
    return pattern(every(B2.white, B1.white, B1.o > B2.c, B0.black, o > B1.o, o < B1.c, c > B2.o, c < B2.c), None, 3)


@op()
def DownsideGapThreeMethods():
    return pattern(None, every(B2.black, B1.black, B1.o < B2.c, B0.white, o > B1.c, o < B1.o, c > B2.c, c < B2.o), 3)


@op()
def StalledPattern():
    return pattern(None, every(B2.real, B1.real, B0.real, B2.white, B1.white, B0.white, c > B1.c, B1.c > B2.c, B2.long(), B1.long(), B0.body <= 0.3 * B0.range, o >= B1.c - 0.1 * B1.range), 3)


@op()
def StickSandwich(): return pattern(every(B2.black, B1.white, B0.black, B1.l > B2.c, abs(c - B2.c) <= 0.1 * B2.range), None, 3)
@op()
def Takuri(): return pattern(every(B0.doji(), B0.upper <= 0.05 * B0.range, B0.lower >= 0.7 * B0.range))


strong = B0.real & B0.long(0.7)


@op()
def ClosingMarubozu(): return pattern(every(strong, B0.white, h - c <= 0.05 * B0.range), every(strong, B0.black, c - l <= 0.05 * B0.range))
@op()
def OpeningMarubozu(): return pattern(every(strong, B0.white, o - l <= 0.05 * B0.range), every(strong, B0.black, h - o <= 0.05 * B0.range))


@op()
def TasukiGap():
    up = every(B2.white, B1.white, B1.o > B2.c, B0.black, o > B1.o, o < B1.c, c < B1.o, c > B2.c)
    down = every(B2.black, B1.black, B1.o < B2.c, B0.white, o < B1.o, o > B1.c, c > B1.o, c < B2.c)
    return pattern(up, down, 3)


@op()
def UniqueThreeRiver():
    return pattern(every(B2.black, B2.long(), B1.black, B1.o <= B2.o, B1.c >= B2.c, B1.l < B2.l, B0.white, B0.body <= 0.3 * B0.range, h <= B1.c), None, 3)


@op()
def ConcealingBabySwallow():
    solid = lambda b: b.marubozu() & b.black
    return pattern(every(solid(B3), solid(B2), B1.black, B1.o < B2.c, B1.h > B2.c, B0.black, o > B1.h, c < B1.l), None, 4)


@op()
def Tristar():
    k = every(B2.doji(), B1.doji(), B0.doji())
    return pattern(every(k, B1.mid < B2.mid, B1.mid < B0.mid), every(k, B1.mid > B2.mid, B1.mid > B0.mid), 3)


@op()
def HaramiCross():
    k = every(~B1.doji(), B0.doji(), inside(o, B1.bottom, B1.top), inside(c, B1.bottom, B1.top))
    return pattern(k & B1.black, k & ~B1.black, 2)


@op()
def TowerTopBottom(tall=0.5, small=0.3):
    k = every(B2.real & B2.long(tall), B0.real & B0.long(tall), B1.size <= small * B1.range)
    return pattern(every(k, ~B2.white, B0.white), every(k, B2.white, ~B0.white), 3)


def bowl(n, sign_):
    def of(w):
        w = sign_ * w
        i = int(w.argmin())
        return 1.0 * sign_ if n // 4 <= i < n - n // 4 and w[-1] > w[0] and w[-1] > w[i] else 0.0

    return window(of, n, c, tag=("bowl", n, sign_))


@op()
def FryPanBottom(period=9): return bowl(period, 1)
@op()
def DumplingTop(period=9): return bowl(period, -1)


@op()
def NewPriceLines(count=5):
    def make():
        k, p = 0, None

        def step(a):
            nonlocal k, p
            if p is None:
                p = a
                return None
            k = max(k, 0) + 1 if a > p else min(k, 0) - 1 if a < p else 0
            p = a
            return -1.0 if k >= count else 1.0 if -k >= count else 0.0

        return step

    return scan(make, c, tag=count)
