"""DuckDB SQL of operators, written by hand from their definitions.

It shares nothing with the expression graphs that make the Spark plans, so a wrong formula on either side shows.
Windows are lists (``w``, and ``z`` of a second column); recursions are recursive CTEs over the row number ``i``,
with ``p`` the row before and ``b`` the row. Defaults only.
"""

from __future__ import annotations

import math


def _final(outs: dict[str, str], out: str, source: str, digits: int) -> str:
    names = {k: out if k == "value" and len(outs) == 1 else f"{out}_{k}" for k in outs}
    cell = lambda k: f"list_transform({k}, lambda q: round(q, {digits}) + 0.0)" if k.startswith("list") else f"round(CAST({k} AS DOUBLE), {digits}) + 0.0"
    return f"SELECT sym, ts, {', '.join(f'{cell(e)} AS {names[k]}' for k, e in outs.items())} FROM {source}"


def _base(source: str, also: str = "") -> str:
    return f"c AS (SELECT *, row_number() OVER o AS i{also} FROM ({source}) s WINDOW o AS (PARTITION BY sym ORDER BY ts), t AS (PARTITION BY sym ORDER BY ts ROWS 9 PRECEDING))"


def _lists(n: int, first: int, w: str, outs: dict[str, str], z: str | None = None, also: str = ""):
    """Outputs from lists of the last n rows, from row ``first`` on."""

    def sql(source: str, out: str, digits: int) -> str:
        over = f"OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        second = f", list({z}) {over} AS z" if z else ""
        return f"WITH {_base(source, also)},\nl AS (SELECT *, list({w}) {over} AS w{second} FROM c)\n" + _final({k: f"CASE WHEN i >= {first} THEN {e} END" for k, e in outs.items()}, out, "l", digits)

    return sql


def _windows(outs: dict[str, str], *stages: dict[str, str]):
    """Outputs from window functions, stage after stage; o: the rows in order, u: all up to this one."""

    def sql(source: str, out: str, digits: int) -> str:
        named = "WINDOW o AS (PARTITION BY sym ORDER BY ts), u AS (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING)"
        steps, at = [_base(source)], "c"
        for k, cols in enumerate(stages):
            steps.append(f"d{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM {at} {named})")
            at = f"d{k}"
        return "WITH " + ",\n".join(steps) + "\n" + _final(outs, out, at, digits)

    return sql


def _steps(first: int, start: dict[str, str], step: dict[str, str], outs: dict[str, str], also: str = "", source: str = "{source}"):
    """Outputs from states that begin at row ``first`` and are carried from row to row."""

    inner = source

    def sql(source: str, out: str, digits: int) -> str:
        source = inner.replace("{source}", source)
        begin = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in start.items())
        go = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in step.items())
        state = f"r AS (SELECT b.*, {begin} FROM c b WHERE i = {first} UNION ALL SELECT b.*, {go} FROM r p JOIN c b ON b.sym = p.sym AND b.i = p.i + 1)"
        every = f"e AS (SELECT c.*, {', '.join(f'r.{k}' for k in start)} FROM c LEFT JOIN r ON r.sym = c.sym AND r.i = c.i)"
        return f"WITH RECURSIVE {_base(source, also)},\n{state},\n{every}\n" + _final(outs, out, "e", digits)

    return sql


def _each(expr: str) -> str:
    """A list over the places of w."""
    return f"list_transform(range(1, len(w) + 1), lambda k: {expr})"


_LEVEL = _each("CASE WHEN list_max(w[1:k]) > 0 THEN (list_max(w[1:k]) - w[k]) / list_max(w[1:k]) ELSE 0.0 END")
_CURVE = "list_transform(range(1, len(w) + 1), lambda k: list_product(list_transform(w[1:k], lambda a: 1 + a)))"
#: Drawdowns of the curve that compounds w, from a start of 1.
_FALLS = f"list_transform(range(1, len(w) + 1), lambda k: 1 - ({_CURVE})[k] / greatest(1.0, list_max(({_CURVE})[1:k])))"
_DEV = "list_transform(w, lambda a: a - list_avg(w))"
_ENTROPY_BIN = "least(9, floor((a - list_min(w)) / (list_max(w) - list_min(w)) * 10))"
_DAY = "ts // 86400000"


def _median(of: str) -> str:
    return f"list_aggregate({of}, 'quantile_cont', 0.5)"


def _rank(x: str) -> str:
    """Ranks of x with ties at their middle."""
    return f"list_transform({x}, lambda a: len(list_filter({x}, lambda m: m < a)) + (len(list_filter({x}, lambda m: m = a)) + 1) / 2.0)"


def _corr(a: str, b: str) -> str:
    n = "len(w)"
    mean = lambda x: f"list_avg({x})"
    cross = lambda x, y: f"list_sum(list_transform(range(1, {n} + 1), lambda k: (({x})[k] - {mean(x)}) * (({y})[k] - {mean(y)})))"
    return f"CASE WHEN {cross(a, a)} * {cross(b, b)} > 0 THEN {cross(a, b)} / sqrt({cross(a, a)} * {cross(b, b)}) ELSE 0.0 END"


def _over_risk(risk: str) -> str:
    return f"CASE WHEN {risk} > 0 THEN list_avg(w) / {risk} ELSE 0.0 END"


def _smoother(n: int) -> tuple[float, float, float]:
    g = math.sqrt(2) * math.pi / n
    b, c = 2 * math.exp(-g) * math.cos(g), -math.exp(-2 * g)
    return 1 - b - c, b, c


_C1, _C2, _C3 = _smoother(10)
_UP = "(greatest(l0 - l1, 0) + greatest(l1 - l2, 0) + greatest(l2 - l3, 0))"
_DOWN = "(greatest(l1 - l0, 0) + greatest(l2 - l1, 0) + greatest(l3 - l2, 0))"
_L0, _L1 = "(0.5 * b.x + 0.5 * p.l0)", "(-0.5 * (0.5 * b.x + 0.5 * p.l0) + p.l0 + 0.5 * p.l1)"
_L2 = f"(-0.5 * {_L1} + p.l1 + 0.5 * p.l2)"
_PAIRS = "list_sum(list_transform(range(1, 21), lambda j: coalesce(list_sum(list_transform(range(1, j), lambda k: {0})), 0)))"
_SA, _SB = "sign(w[j] - w[k])", "sign(z[j] - z[k])"
_STOP = "CASE WHEN p.up > 0 THEN (CASE WHEN b.x < p.s THEN {above} ELSE greatest(p.s, {below}) END) ELSE (CASE WHEN b.x > p.s THEN {below} ELSE least(p.s, {above}) END) END"
_SIDE = "CASE WHEN p.up > 0 THEN (CASE WHEN b.x < p.s THEN -1 ELSE 1 END) ELSE (CASE WHEN b.x > p.s THEN 1 ELSE -1 END) END"


def _ratchet(below: str, above: str):
    return _steps(1, {"s": below, "up": "1"}, {"s": _STOP.format(below=below, above=above), "up": _SIDE}, {"value": "s"})


def _profile(bucket: str, n: int, value: str, stat: str, first: int):
    """A list of a running statistic for every bucket."""

    def sql(source: str, out: str, digits: int) -> str:
        f = "coalesce(avg({0}), 0.0)" if stat == "mean" else "coalesce(stddev_samp({0}), 0.0)"
        cols = ", ".join(f.replace("avg({0})", "avg(y) FILTER (g = {k}) OVER u").replace("stddev_samp({0})", "stddev_samp(y) FILTER (g = {k}) OVER u").replace("{k}", str(k)) for k in range(n))
        return (
            f"WITH {_base(source)},\ng AS (SELECT *, {bucket} AS g, {value} AS y FROM c WINDOW o AS (PARTITION BY sym ORDER BY ts)),\n"
            f"h AS (SELECT sym, ts, i, [{cols}] AS v FROM g WINDOW u AS (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING))\n"
            f"SELECT sym, ts, CASE WHEN i >= {first} THEN list_transform(v, lambda q: round(q, {digits}) + 0.0) END AS {out}_bins FROM h"
        )

    return sql


_RET = "CASE WHEN lag(close) OVER o = 0 THEN 0.0 ELSE close / lag(close) OVER o - 1 END"
_MINUTE = "(ts % 86400000) // 60000"
_SESSION = "PARTITION BY sym, ts // 86400000 ORDER BY ts ROWS UNBOUNDED PRECEDING"


def _session(outs: dict[str, str]):
    def sql(source: str, out: str, digits: int) -> str:
        return f"WITH {_base(source)},\nd AS (SELECT sym, ts, {', '.join(f'{e} AS v_{k}' for k, e in outs.items())} FROM c WINDOW d AS ({_SESSION}), o AS (PARTITION BY sym ORDER BY ts))\n" + _final({k: f"v_{k}" for k in outs}, out, "d", digits)

    return sql


def _range_of(k: int) -> str:
    inside = f"FILTER ({_MINUTE} // 480 = {k})"
    return f"coalesce(max(high) {inside} OVER d - min(low) {inside} OVER d, 0.0)"


def _overnight(outs: dict[str, str]):
    """g: the day's first open against the close before it; n: the close against the day's first open."""

    def sql(source: str, out: str, digits: int) -> str:
        return (
            f"WITH {_base(source)},\na AS (SELECT *, lag(close) OVER (PARTITION BY sym ORDER BY ts) AS pc FROM c),\n"
            f"d AS (SELECT *, first_value(open) OVER d AS fo, first_value(pc) OVER d AS fp FROM a WINDOW d AS ({_SESSION})),\n"
            f"e AS (SELECT *, CASE WHEN fp = 0 THEN 0.0 ELSE fo / fp - 1 END AS g, CASE WHEN fo = 0 THEN 0.0 ELSE close / fo - 1 END AS n FROM d)\n"
        ) + _final(outs, out, "e", digits)

    return sql


def _daily_range(source: str, out: str, digits: int) -> str:
    return (
        f"WITH {_base(source)},\nd AS (SELECT sym, {_DAY} AS day, max(high) - min(low) AS r FROM c GROUP BY 1, 2),\n"
        f"e AS (SELECT *, avg(r) OVER w AS m, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY sym ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),\n"
        f"f AS (SELECT c.sym, c.ts, CASE WHEN n = 14 THEN m END AS v FROM c JOIN e ON c.sym = e.sym AND {_DAY.replace('ts', 'c.ts')} = e.day)\n"
    ) + _final({"value": "v"}, out, "f", digits)


def _falling(side: str, sign: str) -> str:
    """The farthest of the lines of slope s[last] through the highs or lows of w."""
    return f"{'list_max' if sign == '+' else 'list_min'}(list_transform(range(1, 15), lambda k: {side}[k] + s_{side} * (14 - k)))"


def _projection(outs: dict[str, str]):
    def sql(source: str, out: str, digits: int) -> str:
        over = "OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
        return (
            f"WITH {_base(source)},\nl AS (SELECT *, list(high) {over} AS w, list(low) {over} AS z, coalesce(regr_slope(high, i) {over}, 0) AS s_w, coalesce(regr_slope(low, i) {over}, 0) AS s_z FROM c),\n"
            f"m AS (SELECT *, CASE WHEN i >= 14 THEN {_falling('w', '+')} END AS hi, CASE WHEN i >= 14 THEN {_falling('z', '-')} END AS lo FROM l)\n"
        ) + _final(outs, out, "m", digits)

    return sql


def _newest(side: str, best: str) -> str:
    """How recent the extreme of 15 rows is, 14 for the last row."""
    return f"100.0 * (list_max(list_filter(range(1, 16), lambda k: {side}[k] = {best}({side}))) - 1) / 14"


_MAD = _median(f"list_transform(w, lambda a: abs(a - {_median('w')}))")
_BOMAR = "list_aggregate(list_transform(w, lambda a: abs(a - list_avg(w))), 'quantile_cont', 0.85)"
_T = "(k - 15.5)"
_E = "list_transform(range(1, 31), lambda k: list_sum(w[1:k]))"
_B = f"(list_sum(list_transform(range(1, 31), lambda k: {_T} * ({_E})[k])) / 2247.5)"
_SSE = f"list_sum(list_transform(range(1, 31), lambda k: pow(({_E})[k] - list_avg({_E}) - {_B} * {_T}, 2)))"
_LOGS = ", ln(x) - ln(lag(x) OVER o) AS r"



def _ema(of: str, n: int, alpha: float | None = None) -> str:
    """The exponential average of a list, from the mean of its first n values."""
    return f"list_reduce({of}[{n + 1}:], lambda a, q: a + {alpha or 2 / (n + 1)!r} * (q - a), list_avg({of}[1:{n}]))"


def _from(first: int, e: str) -> str:
    return f"CASE WHEN i >= {first} THEN {e} END"


_TR = {"tr": "greatest(high - low, coalesce(abs(high - lag(close) OVER o), 0), coalesce(abs(low - lag(close) OVER o), 0))"}
_TRS = {"l": "list(tr) OVER u"}
_DIFF = {"d": "x - lag(x) OVER o"}
_GAIN = {"g": "list(greatest(d, 0)) OVER u", "f": "list(greatest(-d, 0)) OVER u"}
_X = {"l": "list(x) OVER u"}
_WEIGHTS = "list_sum(list_transform(range(1, 15), lambda k: w[k] * k)) / 105"
_SAR_UP, _SAR_DOWN = "least(p.sar + p.af * (p.ep - p.sar), p.pl, b.low)", "greatest(p.sar + p.af * (p.ep - p.sar), p.ph, b.high)"


def _sar(up_turn: str, up: str, down_turn: str, down: str) -> str:
    return f"CASE WHEN p.up > 0 THEN (CASE WHEN b.low <= {_SAR_UP} THEN {up_turn} ELSE {up} END) ELSE (CASE WHEN b.high >= {_SAR_DOWN} THEN {down_turn} ELSE {down} END) END"


def _banded(n: int, start: dict[str, str], step: dict[str, str], outs: dict[str, str]):
    """States beside a, the average true range of n rows, as it is now in ``start`` and ``step`` ({a})."""
    tr = "greatest(high - low, coalesce(abs(high - lag(close) OVER o), 0), coalesce(abs(low - lag(close) OVER o), 0))"
    now = f"((p.a * {n - 1} + b.tr) / {n})"

    def sql(source: str, out: str, digits: int) -> str:
        with_tr = f"SELECT *, avg(tr) OVER (PARTITION BY sym ORDER BY ts ROWS {n - 1} PRECEDING) AS m FROM (SELECT *, {tr} AS tr FROM ({source}) s WINDOW o AS (PARTITION BY sym ORDER BY ts)) s"
        return _steps(n, {"a": "m"} | {k: e.format(a="m") for k, e in start.items()}, {"a": now} | {k: e.format(a=now) for k, e in step.items()}, outs)(with_tr, out, digits)

    return sql


def _two_pole(n: int, name: str) -> tuple[dict[str, str], dict[str, str]]:
    """States of a high-pass filter with two poles: its value and the one before."""
    a = 0.707 * 2 * math.pi / n
    k = (math.cos(a) + math.sin(a) - 1) / math.cos(a)
    now = f"{(1 - k / 2) ** 2!r} * (b.x - 2 * b.x1 + b.x2) + {2 * (1 - k)!r} * p.{name} - {(1 - k) ** 2!r} * p.{name}b"
    return {name: "0", f"{name}b": "0"}, {name: now, f"{name}b": f"p.{name}"}


_BEFORE = ", lag(x) OVER o AS x1, lag(x, 2) OVER o AS x2"


def _passed(outs: dict[str, str], *periods: int):
    """Outputs from filters f0, f1, ...; the first two values have 0."""
    begin, go = {}, {}
    for j, n in enumerate(periods):
        a, b = _two_pole(n, f"f{j}")
        begin |= a
        go |= b
    return _steps(2, begin, go, {k: "coalesce(" + e.replace("f0", "coalesce(f0, 0)").replace("f1", "coalesce(f1, 0)") + ", 0)" for k, e in outs.items()}, also=_BEFORE)


_K = 2 / 15
_HI = "CASE WHEN (b.high + b.low) / 2 + 3 * {a} < p.hi OR p.close > p.hi THEN (b.high + b.low) / 2 + 3 * {a} ELSE p.hi END"
_LO = "CASE WHEN (b.high + b.low) / 2 - 3 * {a} > p.lo OR p.close < p.lo THEN (b.high + b.low) / 2 - 3 * {a} ELSE p.lo END"
_MACD = {"m": _from(26, f"{_ema('l', 12)} - {_ema('l', 26)}")}

_ONE = "list_avg(list_transform(range(1, 60), lambda k: pow(w[k + 1] - w[k] - (w[60] - w[1]) / 59, 2)))"

#: Pairs of places of 30 from which m values stay together, m of 2 being at hand for a third.
_ALIKE = "list_sum(list_transform(range(2, 29), lambda j: list_sum(list_transform(range(1, j), lambda k: CASE WHEN list_max(list_transform(range(0, {m}), lambda t: abs(w[j + t] - w[k + t]))) <= 0.2 * list_aggregate(w, 'stddev_pop') THEN 1 ELSE 0 END))))"

_PSAR = (
    {"sar": "low", "ep": "high", "ph": "high", "pl": "low", "up": "1", "af": "0.02"},
    {"sar": _sar("p.ep", _SAR_UP, "p.ep", _SAR_DOWN), "ep": _sar("b.low", "greatest(p.ep, b.high)", "b.high", "least(p.ep, b.low)"), "ph": "b.high", "pl": "b.low", "up": _sar("-1", "1", "1", "-1"), "af": _sar("0.02", "CASE WHEN b.high > p.ep THEN least(p.af + 0.02, 0.2) ELSE p.af END", "0.02", "CASE WHEN b.low < p.ep THEN least(p.af + 0.02, 0.2) ELSE p.af END")},
)

SQL = {
    "MedianAbsoluteDeviation": _lists(20, 20, "x", {"value": _MAD}),
    "MedianChannel": _lists(20, 20, "x", {"upper": f"{_median('w')} + 2 * {_MAD}", "middle": _median("w"), "lower": f"{_median('w')} - 2 * {_MAD}"}),
    "BomarBands": _lists(20, 20, "x", {"upper": f"list_avg(w) + {_BOMAR}", "middle": "list_avg(w)", "lower": f"list_avg(w) - {_BOMAR}"}),
    "Autocorrelation": _lists(20, 20, "x", {"value": f"CASE WHEN list_sum(list_transform({_DEV}, lambda a: a * a)) > 0 THEN list_sum(list_transform(range(1, 20), lambda k: ({_DEV})[k] * ({_DEV})[k + 1])) / list_sum(list_transform({_DEV}, lambda a: a * a)) ELSE 0.0 END"}),
    "ShannonEntropy": _lists(20, 20, "x", {"value": f"CASE WHEN list_max(w) > list_min(w) THEN -list_sum(list_transform(list_filter(list_transform(range(0, 10), lambda k: len(list_filter(w, lambda a: {_ENTROPY_BIN} = k)) / 20), lambda q: q > 0), lambda q: q * log2(q))) ELSE 0.0 END"}),
    "RollingPercentileRank": _lists(14, 14, "x", {"value": "100.0 * (len(list_filter(w, lambda a: a < w[14])) + 0.5 * len(list_filter(w, lambda a: a = w[14]))) / 14"}),
    "ConditionalValueAtRisk": _lists(20, 20, "x", {"value": "greatest(0.0, -list_min(w))"}),
    "MaxDrawdown": _lists(20, 20, "x", {"value": f"list_max({_LEVEL})"}),
    "PainIndex": _lists(14, 14, "x", {"value": f"list_avg({_LEVEL})"}),
    "CalmarRatio": _lists(36, 36, "x", {"value": _over_risk(f"list_max({_FALLS})")}),
    "SterlingRatio": _lists(12, 12, "x", {"value": _over_risk(f"list_avg({_FALLS})")}),
    "BurkeRatio": _lists(12, 12, "x", {"value": _over_risk(f"sqrt(list_sum(list_transform({_FALLS}, lambda a: a * a)))")}),
    "MartinRatio": _lists(14, 14, "x", {"value": _over_risk(f"sqrt(list_avg(list_transform({_FALLS}, lambda a: a * a)))")}),
    "KRatio": _lists(30, 30, "x", {"value": f"CASE WHEN {_SSE} > 0 THEN {_B} / sqrt({_SSE} / 28 / 2247.5) ELSE 0.0 END"}),
    "SpearmanCorrelation": _lists(20, 20, "x", {"value": _corr(_rank("w"), _rank("z"))}, z="y"),
    "KendallTau": _lists(20, 20, "x", {"value": f"CASE WHEN {_PAIRS.format(f'abs({_SA})')} * {_PAIRS.format(f'abs({_SB})')} > 0 THEN {_PAIRS.format(f'{_SA} * {_SB}')} / sqrt({_PAIRS.format(f'abs({_SA})')} * CAST({_PAIRS.format(f'abs({_SB})')} AS DOUBLE)) ELSE 0.0 END"}, z="y"),
    "DistanceSsd": _lists(20, 20, "x", {"value": "CASE WHEN w[1] != 0 AND z[1] != 0 THEN list_sum(list_transform(range(1, 21), lambda k: pow(w[k] / w[1] - z[k] / z[1], 2))) ELSE 0.0 END"}, z="y"),
    "Cci": _lists(20, 20, "(high + low + close) / 3", {"value": f"CASE WHEN list_avg(list_transform({_DEV}, lambda a: abs(a))) > 0 THEN (w[20] - list_avg(w)) / (0.015 * list_avg(list_transform({_DEV}, lambda a: abs(a)))) ELSE 0.0 END"}),
    "Aroon": _lists(15, 15, "high", {"up": _newest("w", "list_max"), "down": _newest("z", "list_min")}, z="low"),
    "AroonOscillator": _lists(15, 15, "high", {"value": f"{_newest('w', 'list_max')} - {_newest('z', 'list_min')}"}, z="low"),
    "RollMeasure": _lists(20, 21, "d", {"value": f"2 * sqrt(greatest(0.0, -list_sum(list_transform(range(1, 20), lambda k: ({_DEV})[k] * ({_DEV})[k + 1])) / 19))"}, also=", price - lag(price) OVER o AS d"),
    "ProjectionBands": _projection({"upper": "hi", "middle": "(hi + lo) / 2", "lower": "lo"}),
    "ProjectionOscillator": _projection({"value": "CASE WHEN hi = lo THEN 50.0 ELSE 100 * (close - lo) / (hi - lo) END"}),
    "DrawdownDuration": _windows({"value": "i - last"}, {"top": "max(x) OVER u"}, {"last": "max(CASE WHEN x >= top THEN i END) OVER u"}),
    "RecoveryFactor": _windows({"value": "CASE WHEN first = 0 THEN NULL WHEN worst > 0 THEN (x - first) / first / worst ELSE 0.0 END"}, {"top": "max(x) OVER u", "first": "first_value(x) OVER u"}, {"worst": "max(CASE WHEN top > 0 THEN (top - x) / top ELSE 0.0 END) OVER u"}),
    "Garch11": _steps(2, {"v": repr(0.000002 / (1 - 0.1 - 0.88))}, {"v": "0.000002 + 0.1 * p.r * p.r + 0.88 * p.v"}, {"value": "sqrt(v)"}, also=_LOGS),
    "EwmaVolatility": _steps(2, {"v": "r * r"}, {"v": "0.06 * b.r * b.r + 0.94 * p.v"}, {"value": "sqrt(v)"}, also=_LOGS),
    "McGinleyDynamic": _steps(10, {"m": "a"}, {"m": "CASE WHEN p.m > 0 AND b.x > 0 THEN p.m + (b.x - p.m) / (6 * pow(b.x / p.m, 4)) ELSE p.m END"}, {"value": "m"}, also=", avg(x) OVER (PARTITION BY sym ORDER BY ts ROWS 9 PRECEDING) AS a"),
    "HoltWinters": _steps(2, {"s": "x", "t": "x - lx"}, {"s": "0.2 * b.x + 0.8 * (p.s + p.t)", "t": "0.1 * (0.2 * b.x + 0.8 * (p.s + p.t) - p.s) + 0.9 * p.t"}, {"value": "s + t"}, also=", lag(x) OVER o AS lx"),
    "SuperSmoother": _steps(2, {"y": "x", "y1": "lx"}, {"y": f"{_C1} * (b.x + p.x) / 2 + {_C2} * p.y + {_C3} * p.y1", "y1": "p.y"}, {"value": "CASE WHEN i = 1 THEN x ELSE y END"}, also=", lag(x) OVER o AS lx"),
    "LaguerreRsi": _steps(1, {"l0": "x", "l1": "-0.5 * x + x + 0.5 * x", "l2": "x", "l3": "x"}, {"l0": _L0, "l1": _L1, "l2": _L2, "l3": f"-0.5 * {_L2} + p.l2 + 0.5 * p.l3"}, {"value": f"CASE WHEN {_UP} + {_DOWN} > 0 THEN 100 * {_UP} / ({_UP} + {_DOWN}) ELSE 50.0 END"}),
    "FisherTransform": _steps(10, {"s": "0.33 * raw"}, {"s": "0.33 * b.raw + 0.67 * p.s"}, {"value": "CASE WHEN i >= 10 THEN 0.5 * ln((1 + least(greatest(s, -0.999), 0.999)) / (1 - least(greatest(s, -0.999), 0.999))) END"}, also=", CASE WHEN max(x) OVER t = min(x) OVER t THEN 0.0 ELSE 2 * (x - min(x) OVER t) / (max(x) OVER t - min(x) OVER t) - 1 END AS raw"),
    "PercentageTrailingStop": _ratchet("b.x - abs(b.x) * 0.05", "b.x + abs(b.x) * 0.05"),
    "StepTrailingStop": _ratchet("floor(b.x) - 1", "ceil(b.x) + 1"),
    "Pvi": _steps(1, {"y": "1000"}, {"y": "CASE WHEN p.close != 0 AND b.volume > p.volume THEN p.y + p.y * (b.close - p.close) / p.close ELSE p.y END"}, {"value": "y"}),
    "HeikinAshi": _steps(1, {"q": "(open + close) / 2"}, {"q": "(p.q + (p.open + p.high + p.low + p.close) / 4) / 2"}, {"open": "q", "high": "greatest(high, q, (open + high + low + close) / 4)", "low": "least(low, q, (open + high + low + close) / 4)", "close": "(open + high + low + close) / 4"}),
    "NewPriceLines": _steps(2, {"k": "CASE WHEN close > lc THEN 1 WHEN close < lc THEN -1 ELSE 0 END"}, {"k": "CASE WHEN b.close > p.close THEN greatest(p.k, 0) + 1 WHEN b.close < p.close THEN least(p.k, 0) - 1 ELSE 0 END"}, {"value": "CASE WHEN k >= 5 THEN -1.0 WHEN k <= -5 THEN 1.0 WHEN k IS NOT NULL THEN 0.0 END"}, also=", lag(close) OVER o AS lc"),
    "TdSetup": _steps(5, {"k": "CASE WHEN close < l4 THEN 1 WHEN close > l4 THEN -1 ELSE 0 END"}, {"k": "CASE WHEN b.close < b.l4 THEN least(greatest(p.k, 0) + 1, 9) WHEN b.close > b.l4 THEN greatest(least(p.k, 0) - 1, -9) ELSE 0 END"}, {"value": "k"}, also=", lag(close, 4) OVER o AS l4"),
    "Nrtr": _steps(1, {"w": "close", "way": "1"}, {"w": "CASE WHEN p.way > 0 THEN (CASE WHEN b.close < greatest(p.w, b.close) * 0.98 THEN b.close ELSE greatest(p.w, b.close) END) ELSE (CASE WHEN b.close > least(p.w, b.close) * 1.02 THEN b.close ELSE least(p.w, b.close) END) END", "way": "CASE WHEN p.way > 0 THEN (CASE WHEN b.close < greatest(p.w, b.close) * 0.98 THEN -1 ELSE 1 END) ELSE (CASE WHEN b.close > least(p.w, b.close) * 1.02 THEN 1 ELSE -1 END) END"}, {"value": "w * (1 - 0.02 * way)", "direction": "way"}),
    "Evwma": _steps(20, {"y": "close"}, {"y": "CASE WHEN b.t > 0 THEN ((b.t - b.volume) * p.y + b.volume * b.close) / b.t ELSE p.y END"}, {"value": "y"}, also=", sum(volume) OVER (PARTITION BY sym ORDER BY ts ROWS 19 PRECEDING) AS t"),
    "SampleEntropy": _lists(30, 30, "x", {"value": f"CASE WHEN list_max(w) = list_min(w) OR {_ALIKE.format(m=2)} = 0 THEN 0.0 WHEN {_ALIKE.format(m=3)} = 0 THEN ln({_ALIKE.format(m=2)}) ELSE -ln({_ALIKE.format(m=3)} / {_ALIKE.format(m=2)}) END"}),
    "StochasticCci": _windows({"value": _from(27, "CASE WHEN list_max(l[-14:]) = list_min(l[-14:]) THEN 50.0 ELSE 100 * (k - list_min(l[-14:])) / (list_max(l[-14:]) - list_min(l[-14:])) END")}, {"w": "list((high + low + close) / 3) OVER (PARTITION BY sym ORDER BY ts ROWS 13 PRECEDING)"}, {"k": f"CASE WHEN i >= 14 THEN CASE WHEN list_avg(list_transform({_DEV}, lambda a: abs(a))) > 0 THEN (w[14] - list_avg(w)) / (0.015 * list_avg(list_transform({_DEV}, lambda a: abs(a)))) ELSE 0.0 END END"}, {"l": "list(k) OVER u"}),
    "HeikinAshiOscillator": _steps(1, {"q": "(open + close) / 2"}, {"q": "(p.q + (p.open + p.high + p.low + p.close) / 4) / 2"}, {"value": _from(5, _ema("(list((open + high + low + close) / 4 - q) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING))", 5))}),
    "HighpassFilter": _passed({"value": "f0"}, 48),
    "Decycler": _passed({"value": "x - f0"}, 60),
    "DecyclerOscillator": _passed({"value": "f1 - f0"}, 10, 20),
    "InstantaneousTrendline": _steps(6, {"y": "(x + 2 * x1 + x2) / 4", "yb": "(x1 + 2 * x2 + x3) / 4"}, {"y": f"{_K - _K * _K / 4!r} * b.x + {0.5 * _K * _K!r} * b.x1 - {_K - 0.75 * _K * _K!r} * b.x2 + {2 * (1 - _K)!r} * p.y - {(1 - _K) ** 2!r} * p.yb", "yb": "p.y"}, {"value": "CASE WHEN i < 6 THEN (x + 2 * coalesce(x1, x) + coalesce(x2, x)) / 4 ELSE y END"}, also=_BEFORE + ", lag(x, 3) OVER o AS x3"),
    "VarianceRatio": _lists(60, 60, "x - y", {"value": f"CASE WHEN {_ONE} > 0 THEN list_avg(list_transform(range(1, 59), lambda k: pow(w[k + 2] - w[k] - 2 * (w[60] - w[1]) / 59, 2))) / (2 * {_ONE}) ELSE 1.0 END"}),
    "VolatilityCone": _windows({k: _from(80, e) for k, e in {"current": "s", "min": "list_min(l[-60:])", "median": "list_aggregate(l[-60:], 'quantile_cont', 0.5)", "max": "list_max(l[-60:])", "percentile": "100.0 * len(list_filter(l[-60:], lambda q: q <= s)) / 60"}.items()}, {"r": "ln(x) - ln(lag(x) OVER o)"}, {"s": "CASE WHEN i >= 21 THEN stddev_samp(r) OVER (PARTITION BY sym ORDER BY ts ROWS 19 PRECEDING) END"}, {"l": "list(s) OVER u"}),
    "SeasonalZScore": _windows({"value": "CASE WHEN sd > 0 THEN (r - m) / sd WHEN sd = 0 THEN 0.0 END"}, {"r": f"{_RET}", "hour": f"{_MINUTE} // 60"}, {"sd": "stddev_samp(r) OVER (PARTITION BY sym, hour ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "m": "avg(r) OVER (PARTITION BY sym, hour ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"}),
    "Sma": _lists(14, 14, "x", {"value": "list_avg(w)"}),
    "Wma": _lists(14, 14, "x", {"value": _WEIGHTS}),
    "Ema": _windows({"value": _from(14, _ema("l", 14))}, _X),
    "Smma": _windows({"value": _from(14, _ema("l", 14, 1 / 14))}, _X),
    "Dema": _windows({"value": _from(27, f"2 * e - {_ema('m[14:]', 14)}")}, _X, {"e": _from(14, _ema("l", 14))}, {"m": "list(e) OVER u"}),
    "MacdIndicator": _windows({k: _from(34, e) for k, e in {"macd": "m", "signal": _ema("z", 9), "histogram": f"m - {_ema('z', 9)}"}.items()}, _X, _MACD, {"z": "(list(m) OVER u)[26:]"}),
    "Rsi": _windows({"value": _from(15, f"CASE WHEN {_ema('g[2:]', 14, 1 / 14)} + {_ema('f[2:]', 14, 1 / 14)} = 0 THEN 50.0 ELSE 100 - 100 / (1 + {_ema('g[2:]', 14, 1 / 14)} / nullif({_ema('f[2:]', 14, 1 / 14)}, 0)) END")}, _DIFF, _GAIN),
    "Roc": _windows({"value": "CASE WHEN q = 0 THEN 0.0 ELSE 100 * (x - q) / q END"}, {"q": "lag(x, 10) OVER o"}),
    "Mom": _windows({"value": "x - q"}, {"q": "lag(x, 10) OVER o"}),
    "StdDev": _lists(20, 20, "x", {"value": "sqrt(list_avg(list_transform(w, lambda a: pow(a - list_avg(w), 2))))"}),
    "ZScore": _lists(20, 20, "x", {"value": f"CASE WHEN list_max(w) = list_min(w) THEN 0.0 ELSE (w[20] - list_avg(w)) / sqrt(list_avg(list_transform({_DEV}, lambda a: a * a))) END"}),
    "BollingerBands": _lists(20, 20, "x", {"upper": f"list_avg(w) + 2 * sqrt(list_avg(list_transform({_DEV}, lambda a: a * a)))", "middle": "list_avg(w)", "lower": f"list_avg(w) - 2 * sqrt(list_avg(list_transform({_DEV}, lambda a: a * a)))", "stddev": f"sqrt(list_avg(list_transform({_DEV}, lambda a: a * a)))"}),
    "PearsonCorrelation": _lists(20, 20, "x", {"value": _corr("w", "z")}, z="y"),
    "TrueRange": _windows({"value": "tr"}, _TR),
    "Atr": _windows({"value": _from(14, _ema("l", 14, 1 / 14))}, _TR, _TRS),
    "Natr": _windows({"value": _from(14, f"CASE WHEN close = 0 THEN 0.0 ELSE 100 * {_ema('l', 14, 1 / 14)} / close END")}, _TR, _TRS),
    "Donchian": _lists(20, 20, "high", {"upper": "list_max(w)", "middle": "(list_max(w) + list_min(z)) / 2", "lower": "list_min(z)"}, z="low"),
    "WilliamsR": _lists(14, 14, "high", {"value": "CASE WHEN list_max(w) = list_min(z) THEN -50.0 ELSE -100 * (list_max(w) - close) / (list_max(w) - list_min(z)) END"}, z="low"),
    "Obv": _windows({"value": "t"}, {"d": "coalesce(sign(close - lag(close) OVER o), 0) * volume"}, {"t": "sum(d) OVER u"}),
    "Vwap": _windows({"value": "CASE WHEN b > 0 THEN a / b ELSE (high + low + close) / 3 END"}, {"a": "sum((high + low + close) / 3 * volume) OVER u", "b": "sum(volume) OVER u"}),
    "RollingVwap": _lists(20, 20, "(high + low + close) / 3", {"value": "list_sum(list_transform(range(1, 21), lambda k: w[k] * z[k])) / list_sum(z)"}, z="volume"),
    "Vwma": _lists(14, 14, "close", {"value": "list_sum(list_transform(range(1, 15), lambda k: w[k] * z[k])) / list_sum(z)"}, z="volume"),
    "AwesomeOscillator": _lists(34, 34, "(high + low) / 2", {"value": "list_avg(w[30:34]) - list_avg(w)"}),
    "TypicalPrice": _windows({"value": "(high + low + close) / 3"}, {"n": "0"}),
    "SuperTrend": _banded(10, {"hi": "(high + low) / 2 + 3 * {a}", "lo": "(high + low) / 2 - 3 * {a}", "way": "1"}, {"hi": _HI, "lo": _LO, "way": f"CASE WHEN p.way < 0 THEN (CASE WHEN b.close <= {_HI} THEN -1 ELSE 1 END) ELSE (CASE WHEN b.close >= {_LO} THEN 1 ELSE -1 END) END"}, {"value": "CASE WHEN way > 0 THEN lo WHEN way < 0 THEN hi END", "direction": "way"}),
    "AtrTrailingStop": _banded(14, {"s": "close - 3 * {a}"}, {"s": "CASE WHEN b.close > p.s THEN (CASE WHEN p.close > p.s THEN greatest(b.close - 3 * {a}, p.s) ELSE b.close - 3 * {a} END) WHEN b.close < p.s AND p.close < p.s THEN least(b.close + 3 * {a}, p.s) ELSE b.close + 3 * {a} END"}, {"value": "s"}),
    "VoltyStop": _banded(14, {"e": "close", "up": "1"}, {"e": "CASE WHEN p.up > 0 THEN (CASE WHEN b.close < p.e - 2 * {a} THEN b.close ELSE greatest(p.e, b.close) END) ELSE (CASE WHEN b.close > p.e + 2 * {a} THEN b.close ELSE least(p.e, b.close) END) END", "up": "CASE WHEN p.up > 0 THEN (CASE WHEN b.close < p.e - 2 * {a} THEN -1 ELSE 1 END) ELSE (CASE WHEN b.close > p.e + 2 * {a} THEN 1 ELSE -1 END) END"}, {"value": "e - 2 * a * up"}),
    "Psar": _steps(1, *_PSAR, {"value": "CASE WHEN i > 1 THEN sar END"}),
    "Kama": _steps(11, {"y": "far + k * (x - far)"}, {"y": "p.y + b.k * (b.x - p.y)"}, {"value": "y"}, source="SELECT *, pow(CASE WHEN m > 0 THEN abs(x - far) / m ELSE 0.0 END * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS k FROM (SELECT *, sum(d) OVER (PARTITION BY sym ORDER BY ts ROWS 9 PRECEDING) AS m, lag(x, 10) OVER (PARTITION BY sym ORDER BY ts) AS far FROM (SELECT *, abs(x - lag(x) OVER (PARTITION BY sym ORDER BY ts)) AS d FROM ({source}) s) s) s"),
    "SessionVwap": _session({"value": "sum((high + low + close) / 3 * volume) OVER d / sum(volume) OVER d"}),
    "SessionHighLow": _session({"high": "max(high) OVER d", "low": "min(low) OVER d"}),
    "SessionRange": _session({"asia": _range_of(0), "eu": _range_of(1), "us": _range_of(2)}),
    "AverageDailyRange": _daily_range,
    "OvernightGap": _overnight({"value": "g"}),
    "OvernightIntradayReturn": _overnight({"overnight": "g", "intraday": "CASE WHEN g IS NOT NULL THEN n END"}),
    "TimeOfDayReturnProfile": _profile(f"{_MINUTE} // 60", 24, _RET, "mean", 2),
    "DayOfWeekProfile": _profile(f"({_DAY} + 3) % 7", 7, _RET, "mean", 2),
    "IntradayVolatilityProfile": _profile(f"{_MINUTE} // 60", 24, _RET, "std", 2),
    "VolumeByTimeProfile": _profile(f"{_MINUTE} // 60", 24, "volume", "mean", 1),
}


def _staged(*stages: dict[str, str]) -> str:
    """A source with columns of window functions, stage after stage; rn: the row's number."""
    named = "WINDOW o AS (PARTITION BY sym ORDER BY ts), u AS (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    sql = f"SELECT *, row_number() OVER o AS rn FROM ({{source}}) s {named}"
    for cols in stages:
        sql = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM ({sql}) s {named}"
    return sql


def _after(outs: dict[str, str], first: int, start: dict[str, str], step: dict[str, str], *stages: dict[str, str], also: str = "", source: str = "{source}"):
    """As _windows, but over the states that _steps carries."""

    def sql(base: str, out: str, digits: int) -> str:
        carried = _steps(first, start, step, {"value": "0"}, also=also, source=source)(base, out, digits).rsplit("\nSELECT", 1)[0]
        named = "WINDOW o AS (PARTITION BY sym ORDER BY ts), u AS (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING)"
        at = "e"
        for k, cols in enumerate(stages):
            carried += f",\nd{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM {at} {named})"
            at = f"d{k}"
        return carried + "\n" + _final(outs, out, at, digits)

    return sql


def _high_passed(gain: float, decay: float, n: int) -> tuple[dict[str, str], dict[str, str]]:
    """States: h, a high-pass filter with one pole, and y, its smoothed value."""
    c1, c2, c3 = _smoother(n)
    h = f"({gain!r} * (b.x - p.x) + {decay!r} * p.h)"
    return {"h": "0", "y": "0", "yb": "0"}, {"h": h, "y": f"CASE WHEN b.i = 2 THEN {h} ELSE {c1!r} * ({h} + p.h) / 2 + {c2!r} * p.y + {c3!r} * p.yb END", "yb": "p.y"}


def _roof() -> tuple[float, float]:
    a = 2 * math.pi / 48
    k = (math.cos(a) + math.sin(a) - 1) / math.cos(a)
    return 1 - k / 2, 1 - k


_EVEN = (1 - math.sin(2 * math.pi / 40)) / math.cos(2 * math.pi / 40)


def _rows(n: int, end: int = 0) -> str:
    """The n rows that end ``end`` rows ago."""
    return f"OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN {n + end - 1} PRECEDING AND {end or 'CURRENT'} {'PRECEDING' if end else 'ROW'})"


def _stochastic(now: str, end: int) -> str:
    hi, lo = f"max(y) {_rows(20, end)}", f"min(y) {_rows(20, end)}"
    return f"CASE WHEN {hi} > {lo} THEN 2 * ({now} - {lo}) / ({hi} - {lo}) - 1 ELSE 0 END"


def _flex(s: str):
    c1, c2, c3 = _smoother(20)
    return _after(
        {"value": "CASE WHEN ms > 0 THEN s / sqrt(ms) WHEN i >= 21 THEN 0.0 END"}, 2, {"y": "x", "yb": "x1"}, {"y": f"{c1!r} * (b.x + p.x) / 2 + {c2!r} * p.y + {c3!r} * p.yb", "yb": "p.y"},
        {"f": "coalesce(y, x)"}, {"s": f"CASE WHEN i >= 21 THEN {s} END"}, {"ms": "CASE WHEN i >= 21 THEN list_reduce((list(s) OVER u)[21:], lambda a, q: 0.96 * a + 0.04 * q * q, 0.0) END"}, also=", lag(x) OVER o AS x1",
    )


def _band_pass(angle: float, n: int) -> dict[str, str]:
    g = 1 / math.cos(angle)
    a = g - math.sqrt(g * g - 1)
    return {"y": f"{0.5 * (1 - a)!r} * (b.x - b.x2) + {math.cos(2 * math.pi / n) * (1 + a)!r} * p.y - {a!r} * p.yb", "yb": "p.y"}


_CHANGES = {"d": "x - lag(x) OVER o"}
_FAST, _SLOW = 2 / 3, 2 / 31


def _paced(value: str, n: int) -> dict[str, str]:
    """k: the pace of an average that follows the efficiency of n changes."""
    return {"k": f"pow(CASE WHEN sum(abs(d)) {_rows(n)} > 0 THEN abs({value} - lag({value}, {n}) OVER o) / sum(abs(d)) {_rows(n)} ELSE 0 END * {_FAST - _SLOW!r} + {_SLOW!r}, 2)"}


def _turn(first: int, long: str, short: str, up: str, down: str, start_way: str = "1", make=None, source: str = "{source}"):
    """A stop that ratchets on one side of the close and changes sides when the close passes it."""
    begin = {"s": long.replace("b.", ""), "way": start_way}
    go = {
        "s": f"CASE WHEN p.way > 0 THEN (CASE WHEN b.close < {up} THEN {short} ELSE {up} END) ELSE (CASE WHEN b.close > {down} THEN {long} ELSE {down} END) END",
        "way": f"CASE WHEN p.way > 0 THEN (CASE WHEN b.close < {up} THEN -1 ELSE 1 END) ELSE (CASE WHEN b.close > {down} THEN 1 ELSE -1 END) END",
    }
    outs = {"value": "s", "direction": "way"}
    return make(first, begin, go, outs) if make else _steps(first, begin, go, outs, source=source)


_ELDER = _staged(
    {"dn": "greatest(lag(low) OVER o - low, 0)", "up": "greatest(high - lag(high) OVER o, 0)"},
    {"lo": f"low - 2 * coalesce(sum(dn) {_rows(14)} / nullif(count(*) FILTER (dn > 0) {_rows(14)}, 0), 0)", "hi": f"high + 2 * coalesce(sum(up) {_rows(14)} / nullif(count(*) FILTER (up > 0) {_rows(14)}, 0), 0)"},
)
_KASE = _staged({"d": "greatest(high, lag(high) OVER o) - least(low, lag(low) OVER o)"}, {"w": f"avg(d) {_rows(30)} + stddev_samp(d) {_rows(30)}"})
_KASE_UP, _KASE_DOWN = "greatest(p.s, greatest(p.m, b.high) - b.w)", "least(p.s, least(p.m, b.low) + b.w)"
_WILDER = {"l": "list(close) OVER u"}


def _setup_way(k: str, below: str = "9") -> str:
    return f"CASE WHEN {k} >= {below} THEN 1 WHEN {k} <= -{below} THEN -1 ELSE 0 END"


def _countdown(also: str, outs: dict[str, str]):
    """k: the setup's count; way: the side of the last full one; n: rows that qualified since."""
    k = "(CASE WHEN b.close < b.l4 THEN least(greatest(p.k, 0) + 1, 9) WHEN b.close > b.l4 THEN greatest(least(p.k, 0) - 1, -9) ELSE 0 END)"
    done = f"({_setup_way(k)})"
    way = f"(CASE WHEN {done} != 0 THEN {done} ELSE p.way END)"
    n = f"(CASE WHEN {done} != 0 AND {done} != p.way THEN 0 ELSE p.n END)"
    ok = f"(CASE WHEN {way} > 0 THEN b.close <= b.low2{also.format('b.low <= p.low AND b.close < p.close')} WHEN {way} < 0 THEN b.close >= b.high2{also.format('b.high >= p.high AND b.close > p.close')} ELSE false END)"
    return _steps(5, {"k": "sign(l4 - close)", "way": "0", "n": "0"}, {"k": k, "way": way, "n": f"CASE WHEN {ok} AND {n} < 13 THEN {n} + 1 ELSE {n} END"}, outs, also=", lag(close, 4) OVER o AS l4, lag(low, 2) OVER o AS low2, lag(high, 2) OVER o AS high2")


def _levels(names: tuple[str, str], buy: tuple[str, str], sell: tuple[str, str]):
    """m: the extreme row of a run below (b) or above (s) the close four rows before; its level counts at the ninth row.
    Each of buy and sell: (whether the row replaces the extreme, the row's level)."""
    w = "sign(b.l4 - b.close)"
    same = f"(p.k * {w} > 0)"
    k = f"(CASE WHEN {w} = 0 THEN 0 ELSE {w} * least(CASE WHEN {same} THEN abs(p.k) ELSE 0 END + 1, 9) END)"
    e = f"CASE WHEN {w} = 0 THEN NULL WHEN {w} > 0 THEN (CASE WHEN {same} AND NOT ({buy[0]}) THEN p.{{0}} ELSE {{1}} END) ELSE (CASE WHEN {same} AND NOT ({sell[0]}) THEN p.{{0}} ELSE {{2}} END) END"
    m, q = e.format("m", buy[2], sell[2]), e.format("q", buy[1], sell[1])
    b0 = lambda z: z.replace("b.", "")
    start = {"k": "sign(l4 - close)", "m": b0(f"CASE WHEN {w} > 0 THEN {buy[2]} WHEN {w} < 0 THEN {sell[2]} END"), "q": b0(f"CASE WHEN {w} > 0 THEN {buy[1]} WHEN {w} < 0 THEN {sell[1]} END"), "buy": "NULL", "sell": "NULL"}
    go = {"k": k, "m": m, "q": q, "buy": f"CASE WHEN {k} = 9 THEN ({q}) ELSE p.buy END", "sell": f"CASE WHEN {k} = -9 THEN ({q}) ELSE p.sell END"}
    return _steps(5, start, go, {names[0]: "buy", names[1]: "sell"}, source=_staged({"l4": "lag(close, 4) OVER o", "tr": _TR["tr"]}))


def _touched(n: int, bins: int, share: str, outs: dict[str, str]):
    """z: the weight of every price bin that n bars touch; a, b: lowest and highest price; t: a bin's width."""
    place = lambda side: f"list_transform({side}, lambda q: least({bins - 1}, greatest(0, floor((q - a) / ((b - a) / {bins})))))"
    inside = f"list_transform(range(0, {bins}), lambda g: list_sum(list_transform(range(1, {n + 1}), lambda k: CASE WHEN fs[k] <= g AND g <= ts_[k] THEN {share} ELSE 0.0 END)))"
    return _windows(
        {k: f"CASE WHEN i >= {n} THEN {e} END" if not e.startswith("list") else f"list_transform(CASE WHEN i >= {n} THEN {e} END, lambda q: q)" for k, e in outs.items()},
        {"hs": f"list(high) {_rows(n)}", "ls": f"list(low) {_rows(n)}", "vs": f"list(volume) {_rows(n)}"}, {"a": "list_min(ls)", "b": "list_max(hs)"},
        {"t": f"(b - a) / {bins}", "fs": place("ls"), "ts_": place("hs")}, {"z": f"CASE WHEN b > a AND i >= {n} THEN {inside} END"},
    )


_VOLUME = "vs[k] / (ts_[k] - fs[k] + 1)"


def _slope(points: str) -> str:
    """Least-squares slope through a list of (x, y)."""
    mx, my = f"list_avg(list_transform({points}, lambda q: q[1]))", f"list_avg(list_transform({points}, lambda q: q[2]))"
    return f"list_sum(list_transform({points}, lambda q: (q[1] - {mx}) * (q[2] - {my}))) / list_sum(list_transform({points}, lambda q: pow(q[1] - {mx}, 2)))"


_PARTS = [(k, j) for k in range(1, 5) for j in range(k)]


def _part(k: int, j: int) -> str:
    return f"w[{j * (100 // k) + 1}:{(j + 1) * (100 // k)}]"


_HURST = (
    {f"p{k}{j}": f"list_transform({_part(k, j)}, lambda q: q - list_avg({_part(k, j)}))" for k, j in _PARTS},
    {f"z{k}{j}": f"list_transform(range(1, {100 // k + 1}), lambda g: list_sum(p{k}{j}[1:g]))" for k, j in _PARTS},
    {f"r{k}": "list_avg(list_filter([" + ", ".join(f"(list_max(z{k}{j}) - list_min(z{k}{j})) / nullif(list_aggregate(p{k}{j}, 'stddev_pop'), 0)" for j in range(k)) + "], lambda q: q > 0))" for k in range(1, 5)},
    {"pts": "list_filter([" + ", ".join(f"[ln({100 // k}), ln(r{k})]" for k in range(1, 5)) + "], lambda q: q[2] IS NOT NULL)"},
)
_WP, _ZP = "w[11:30]", "z[11 + k:30 + k]"
_CO = "list_sum(list_transform(range(1, 21), lambda m: ({0}[m] - list_avg({0})) * ({1}[m] - list_avg({1}))))"
_LEAD = f"list_transform(range(-10, 11), lambda k: CASE WHEN {_CO.format(_WP, _WP)} * {_CO.format(_ZP, _ZP)} > 0 THEN {_CO.format(_WP, _ZP)} / sqrt({_CO.format(_WP, _WP)} * {_CO.format(_ZP, _ZP)}) ELSE 0.0 END)"
_RW = "list_max(list_transform(range(2, 15), lambda k: greatest(0.0, {0} / nullif(list_avg(rs[16 - k:14]) * sqrt(k), 0))))"


def _strength(g: str, f: str, n: int) -> str:
    """The relative strength index of n from lists of gains and losses."""
    up, down = _ema(g, n, 1 / n), _ema(f, n, 1 / n)
    return f"CASE WHEN {up} + {down} = 0 THEN 50.0 ELSE 100 * {up} / ({up} + {down}) END"


def _cascade(z: str, name: str, prior: str) -> tuple[dict[str, str], str]:
    """Three pairs of filters, each fed by the one before; prior: where their last values are, or empty for 0."""
    a = 3 / 16
    last = lambda j: f"{prior}{name}{j}" if prior else "0"
    cols = {}
    for j in (0, 2, 4):
        cols[f"{name}{j}"] = f"({1 - a!r} * {last(j)} + {a!r} * {z})"
        cols[f"{name}{j + 1}"] = f"({a!r} * {cols[f'{name}{j}']} + {1 - a!r} * {last(j + 1)})"
        z = f"(1.5 * {cols[f'{name}{j}']} - 0.5 * {cols[f'{name}{j + 1}']})"
    return cols, z


_RSX = {"value": "CASE WHEN i >= 15 THEN CASE WHEN 1.5 * m4 - 0.5 * m5 > 0 THEN least(100, greatest(0, ((1.5 * s4 - 0.5 * s5) / (1.5 * m4 - 0.5 * m5) + 1) * 50)) ELSE 50.0 END END"}
_QL = "(CASE WHEN p.r > p.lo AND b.r > p.lo THEN greatest(b.r - b.w, p.lo) ELSE b.r - b.w END)"
_QH = "(CASE WHEN p.r < p.hi AND b.r < p.hi THEN least(b.r + b.w, p.hi) ELSE b.r + b.w END)"
_QQE = _staged(
    _DIFF, _GAIN, {"q": f"CASE WHEN rn >= 15 THEN {_strength('g[2:]', 'f[2:]', 14)} END"}, {"qs": "list(q) OVER u"}, {"r": f"CASE WHEN rn >= 19 THEN {_ema('qs[15:]', 5)} END"},
    {"m": "abs(r - lag(r) OVER o)"}, {"ms": "list(m) OVER u"}, {"e": f"CASE WHEN rn >= 46 THEN {_ema('ms[20:]', 27)} END"}, {"es": "list(e) OVER u"}, {"w": f"CASE WHEN rn >= 72 THEN 4.236 * {_ema('es[46:]', 27)} END"},
)
_DM = "(CASE WHEN b.dm > p.dm THEN 1 WHEN b.dm < p.dm THEN -1 ELSE p.way END)"
_DEPTHS = "list_transform(list_filter(range(2, 21), lambda k: d[k] > 0 AND d[k - 1] = 0), lambda k: list_max(d[k:coalesce(list_min(list_filter(range(k, 21), lambda m: d[m] = 0)), 21) - 1]))"


def _grown(of, state: str):
    """Without rounding from 2^33 on, where neighbouring doubles are more than a millionth apart and DuckDB's round() adds an error."""

    def sql(source: str, out: str, digits: int) -> str:
        rounded = f"round(CAST({state} AS DOUBLE), {digits})"
        return of(source, out, digits).replace(rounded, f"CASE WHEN abs({state}) < 8589934592 THEN {rounded} ELSE {state} END")

    return sql


def _month_turn(source: str, out: str, digits: int) -> str:
    date = "DATE '1970-01-01' + CAST(day AS INTEGER)"
    return (
        f"WITH {_base(source)},\nd AS (SELECT sym, {_DAY} AS day, arg_max(close, ts) AS x FROM c GROUP BY 1, 2),\n"
        f"e AS (SELECT *, x / lag(x) OVER (PARTITION BY sym ORDER BY day) - 1 AS r, day({date}) <= 3 OR last_day({date}) = {date} AS t FROM d),\n"
        "f AS (SELECT *, avg(r) FILTER (t) OVER (PARTITION BY sym ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM e),\n"
        f"h AS (SELECT c.sym, c.ts, f.v FROM c JOIN f ON c.sym = f.sym AND {_DAY.replace('ts', 'c.ts')} = f.day)\n"
    ) + _final({"value": "v"}, out, "h", digits)


_HEIKIN = _staged({f"l{k}": f"list({k}) OVER u" for k in ("open", "high", "low", "close")}, {f"e{k}": f"CASE WHEN rn >= 5 THEN {_ema(f'l{k}', 5)} END" for k in ("open", "high", "low", "close")})
_MEAN4 = "(eopen + ehigh + elow + eclose) / 4"

SQL |= {
    "Nvi": _grown(_steps(1, {"y": "1000"}, {"y": "CASE WHEN p.close != 0 AND b.volume < p.volume THEN p.y + p.y * (b.close - p.close) / p.close ELSE p.y END"}, {"value": "y"}), "y"),
    "AverageDrawdown": _windows({"value": _from(20, f"coalesce(list_avg({_DEPTHS}), 0.0)")}, {"w": f"list(x) {_rows(20)}"}, {"d": _LEVEL}),
    "FryPanBottom": _lists(9, 9, "close", {"value": "CASE WHEN list_position(w, list_min(w)) BETWEEN 3 AND 7 AND w[9] > w[1] AND w[9] > list_min(w) THEN 1.0 ELSE 0.0 END"}),
    "DumplingTop": _lists(9, 9, "close", {"value": "CASE WHEN list_position(w, list_max(w)) BETWEEN 3 AND 7 AND w[9] < w[1] AND w[9] < list_max(w) THEN -1.0 ELSE 0.0 END"}),
    "Frama": _steps(16, {"y": "x"}, {"y": "p.y + b.k * (b.x - p.y)"}, {"value": "y"}, source=_staged(
        {"r8": f"(max(x) {_rows(8)} - min(x) {_rows(8)}) / 8", "r16": f"(max(x) {_rows(16)} - min(x) {_rows(16)}) / 16"}, {"o8": "lag(r8, 8) OVER o"},
        {"k": "CASE WHEN r8 > 0 AND o8 > 0 AND r16 > 0 THEN least(1, greatest(0.01, exp(-4.6 * (log2(r8 + o8) - log2(r16) - 1)))) ELSE 0.01 END"})),
    "Vidya": _steps(10, {"y": "x"}, {"y": "p.y + b.k * (b.x - p.y)"}, {"value": "y"}, source=_staged(_CHANGES, {"k": f"CASE WHEN sum(abs(d)) {_rows(9)} > 0 THEN abs(sum(d) {_rows(9)}) / sum(abs(d)) {_rows(9)} ELSE 0 END * 2 / 15"})),
    "CyberneticCycle": _steps(2, {"y": "(x - x1) / 2", "yb": "0"}, {"y": f"{(1 - _K / 2) ** 2!r} * (b.s - 2 * b.s1 + b.s2) + {2 * (1 - _K)!r} * p.y - {(1 - _K) ** 2!r} * p.yb", "yb": "p.y"}, {"value": "coalesce(y, 0)"}, source=_staged(
        {"x1": "lag(x) OVER o", "s": "coalesce((x + 2 * lag(x) OVER o + 2 * lag(x, 2) OVER o + lag(x, 3) OVER o) / 6, x)"}, {"s1": "lag(s) OVER o", "s2": "lag(s, 2) OVER o"})),
    "BandpassFilter": _steps(2, {"y": "0", "yb": "0"}, _band_pass(4 * math.pi * 0.3 / 20, 20), {"value": "coalesce(y, 0)"}, also=_BEFORE),
    "RoofingFilter": _steps(1, *_high_passed(*_roof(), 10), {"value": "y"}),
    "EhlersStochastic": _after({"value": "CASE WHEN i = 20 THEN k WHEN i > 20 THEN (k + kb) / 2 END"}, 1, *_high_passed(*_roof(), 10), {"k": _stochastic("y", 0), "kb": _stochastic("lag(y) OVER o", 1)}),
    "EvenBetterSinewave": _after({"value": _from(3, "CASE WHEN q > 0 THEN least(1, greatest(-1, m / sqrt(q))) ELSE 0.0 END")}, 1, *_high_passed((1 + _EVEN) / 2, _EVEN, 10), {"m": f"avg(y) {_rows(3)}", "q": f"avg(y * y) {_rows(3)}"}),
    "Trendflex": _flex("f - avg(f) " + _rows(20, 1)),
    "Reflex": _flex("f - avg(f) " + _rows(20, 1) + " + (lag(f, 20) OVER o - f) / 20 * 10.5"),
    "UniversalOscillator": (lambda y: _steps(3, {"y": "v", "yb": "v", "k": "abs(v)"}, {"y": y, "yb": "p.y", "k": f"greatest(abs({y}), 0.991 * p.k)"}, {"value": "CASE WHEN k > 0 THEN least(1, greatest(-1, y / k)) WHEN k = 0 THEN 0.0 END"}, also=", (x - lag(x, 2) OVER o) / 2 AS v"))(
        "(CASE WHEN b.i = 4 THEN b.v ELSE {!r} * (b.v + p.v) / 2 + {!r} * p.y + {!r} * p.yb END)".format(*_smoother(20))),
    "AdaptiveRsi": _steps(15, {"a": "m", "z": "n"}, {"a": "p.a + b.k * (greatest(b.d, 0) - p.a)", "z": "p.z + b.k * (greatest(-b.d, 0) - p.z)"}, {"value": "CASE WHEN a + z > 0 THEN 100 * a / (a + z) WHEN a + z = 0 THEN 50.0 END"},
        source=_staged(_CHANGES, {"m": f"avg(greatest(d, 0)) {_rows(14)}", "n": f"avg(greatest(-d, 0)) {_rows(14)}"} | _paced("x", 14))),
    "AdaptiveCci": _after({"value": _from(20, "coalesce((tp - a) / nullif(0.015 * list_avg(list_transform(w, lambda q: abs(q - a))), 0), 0.0)")}, 20, {"a": "m"}, {"a": "p.a + b.k * (b.tp - p.a)"},
        source=_staged({"tp": "(high + low + close) / 3"}, {"d": "tp - lag(tp) OVER o", "m": f"avg(tp) {_rows(20)}", "w": f"list(tp) {_rows(20)}"}, _paced("tp", 19))),
    "ElderSafeZone": _turn(15, "b.lo", "b.hi", "greatest(p.s, b.lo)", "least(p.s, b.hi)", source=_ELDER),
    "AtrRatchet": _turn(14, "b.close - 4 * {a}", "b.close + 4 * {a}", "(p.s + 0.1 * {a})", "(p.s - 0.1 * {a})", make=_banded),
    "ModifiedMaStop": _turn(14, "b.m", "b.m", "greatest(p.s, b.m)", "least(p.s, b.m)", "CASE WHEN close >= m THEN 1 ELSE -1 END", source=_staged(_WILDER, {"m": f"CASE WHEN rn >= 14 THEN {_ema('l', 14, 1 / 14)} END"})),
    "KaseDevStop": _steps(31, {"m": "high", "s": "high - w", "way": "1"}, {
        "m": f"CASE WHEN p.way > 0 THEN (CASE WHEN b.close < {_KASE_UP} THEN b.low ELSE greatest(p.m, b.high) END) ELSE (CASE WHEN b.close > {_KASE_DOWN} THEN b.high ELSE least(p.m, b.low) END) END",
        "s": f"CASE WHEN p.way > 0 THEN (CASE WHEN b.close < {_KASE_UP} THEN b.low + b.w ELSE {_KASE_UP} END) ELSE (CASE WHEN b.close > {_KASE_DOWN} THEN b.high - b.w ELSE {_KASE_DOWN} END) END",
        "way": f"CASE WHEN p.way > 0 THEN (CASE WHEN b.close < {_KASE_UP} THEN -1 ELSE 1 END) ELSE (CASE WHEN b.close > {_KASE_DOWN} THEN 1 ELSE -1 END) END"}, {"value": "s", "direction": "way"}, source=_KASE),
    "YoyoExit": _banded(14, {"t": "close - 2 * {a}", "held": "1"}, {"t": "CASE WHEN p.held > 0 THEN (CASE WHEN b.close < p.t THEN p.t ELSE greatest(p.t, b.close - 2 * {a}) END) WHEN b.close > p.t + 2 * {a} THEN b.close - 2 * {a} ELSE p.t END",
        "held": "CASE WHEN p.held > 0 THEN (CASE WHEN b.close < p.t THEN 0 ELSE 1 END) WHEN b.close > p.t + 2 * {a} THEN 1 ELSE 0 END"}, {"value": "t"}),
    "RenkoTrailingStop": _steps(1, {"a": "x", "up": "1"}, {"a": "CASE WHEN p.up > 0 THEN (CASE WHEN b.x < p.a - 1 THEN b.x ELSE p.a + greatest(0, floor(b.x - p.a)) END) ELSE (CASE WHEN b.x > p.a + 1 THEN b.x ELSE p.a - greatest(0, floor(p.a - b.x)) END) END",
        "up": "CASE WHEN p.up > 0 THEN (CASE WHEN b.x < p.a - 1 THEN -1 ELSE 1 END) ELSE (CASE WHEN b.x > p.a + 1 THEN 1 ELSE -1 END) END"}, {"value": "a - up"}),
    "SarExt": _steps(1, *_PSAR, {"value": "CASE WHEN i > 1 THEN sar * up END"}),
    "TurnOfMonth": _month_turn,
    "TdCountdown": _countdown("", {"value": "n * way"}),
    "TdSequential": _countdown("", {"setup": "k", "countdown": "n * way", "direction": "way"}),
    "TdCombo": _countdown(" AND {}", {"value": "n * way"}),
    "TdLines": _levels(("resistance", "support"), ("b.high > p.m", "b.high", "b.high"), ("b.low < p.m", "b.low", "b.low")),
    "TdRiskLevel": _levels(("buy_risk", "sell_risk"), ("p.m > b.low", "b.low - b.tr", "b.low"), ("p.m < b.high", "b.high + b.tr", "b.high")),
    "SmoothedHeikinAshi": _steps(5, {"q": "(eopen + eclose) / 2"}, {"q": "(p.q + (p.eopen + p.ehigh + p.elow + p.eclose) / 4) / 2"},
        {"open": "q", "high": f"CASE WHEN i >= 5 THEN greatest(ehigh, q, {_MEAN4}) END", "low": f"CASE WHEN i >= 5 THEN least(elow, q, {_MEAN4}) END", "close": _MEAN4}, source=_HEIKIN),
    "HurstExponent": _windows({"value": _from(100, f"CASE WHEN len(pts) < 2 THEN 0.5 ELSE least(1, greatest(0, {_slope('pts')})) END")}, {"w": f"list(x) {_rows(100)}"}, *_HURST),
    "SpreadHurst": _windows({"value": _from(60, f"CASE WHEN len(pts) < 2 THEN 0.5 ELSE least(1, greatest(0, {_slope('pts')} / 2)) END")}, {"w": f"list(x - y) {_rows(60)}"},
        {"v": "list_transform(range(1, 16), lambda k: list_avg(list_transform(range(1, 61 - k), lambda m: pow(w[m + k] - w[m], 2))))"}, {"pts": "list_transform(list_filter(range(1, 16), lambda k: v[k] > 0), lambda k: [ln(k), ln(v[k])])"}),
    "LeadLagCrossCorrelation": _windows({"lag": _from(40, "j - 11"), "correlation": _from(40, "r[j]")}, {"w": f"list(x) {_rows(40)}", "z": f"list(y) {_rows(40)}"}, {"r": f"CASE WHEN i >= 40 THEN {_LEAD} END"},
        {"j": "list_position(list_transform(r, lambda q: abs(q)), list_max(list_transform(r, lambda q: abs(q))))"}),
    "Rwi": _windows({"high": _from(14, "coalesce(" + _RW.format("(hs[14] - ls[15 - k])") + ", 0)"), "low": _from(14, "coalesce(" + _RW.format("(hs[15 - k] - ls[14])") + ", 0)")}, _TR, {"hs": f"list(high) {_rows(14)}", "ls": f"list(low) {_rows(14)}", "rs": f"list(tr) {_rows(14)}"}),
    "Kvo": _after({"value": _from(56, f"{_ema('l[2:]', 34)} - {_ema('l[2:]', 55)}")}, 2, {"way": "sign(dm - lag_dm)", "t": "lag_dm + dm"}, {"way": _DM, "t": f"CASE WHEN {_DM} = p.way AND p.way != 0 THEN p.t + b.dm ELSE p.dm + b.dm END"},
        {"f": "CASE WHEN t != 0 THEN volume * abs(2 * (dm / t - 1)) * way * 100 ELSE 0 END"}, {"l": "list(f) OVER u"}, source=_staged({"dm": "high + low + close"}, {"lag_dm": "lag(dm) OVER o"})),
    "Qqe": _steps(72, {"lo": "r - w", "hi": "r + w", "up": "1"}, {"lo": _QL, "hi": _QH, "up": "CASE WHEN b.r > p.hi THEN 1 WHEN b.r < p.lo THEN 0 ELSE p.up END"}, {"rsi_ma": _from(72, "r"), "trailing_line": "CASE WHEN up > 0 THEN lo ELSE hi END"}, source=_QQE),
    "ConnorsRsi": _after({"value": _from(101, f"({_strength('g[2:]', 'f[2:]', 3)} + {_strength('kg[3:]', 'kf[3:]', 2)} + 100.0 * len(list_filter(w, lambda q: q < w[100])) / 100) / 3")}, 2, {"k": "sign(x - x1)"},
        {"k": "CASE WHEN b.x > p.x THEN greatest(p.k, 0) + 1 WHEN b.x < p.x THEN least(p.k, 0) - 1 ELSE 0 END"}, {"d": "x - lag(x) OVER o", "e": "k - lag(k) OVER o", "r": "CASE WHEN x1 != 0 THEN 100 * (x - x1) / x1 ELSE 0 END"},
        _GAIN | {"kg": "list(greatest(e, 0)) OVER u", "kf": "list(greatest(-e, 0)) OVER u", "w": f"list(r) {_rows(100)}"}, also=", lag(x) OVER o AS x1"),
    "DynamicMomentumIndex": _windows({"value": _from(31, "CASE WHEN list_sum(list_transform(w[31 - k:], lambda q: abs(q))) > 0 THEN 100 * list_sum(list_transform(w[31 - k:], lambda q: greatest(q, 0))) / list_sum(list_transform(w[31 - k:], lambda q: abs(q))) ELSE 50.0 END")},
        {"sd": f"stddev_pop(x) {_rows(5)}", "d": "x - lag(x) OVER o"}, {"av": "avg(sd) OVER (PARTITION BY sym, i >= 5 ORDER BY ts ROWS 9 PRECEDING)", "w": f"list(d) {_rows(30)}"}, {"k": "CAST(CASE WHEN sd > 0 AND av > 0 THEN least(30, greatest(5, round(14 * av / sd))) ELSE 30 END AS INTEGER)"}),
    "Rsx": _steps(2, _cascade("d", "s", "")[0] | _cascade("abs(d)", "m", "")[0], _cascade("b.d", "s", "p.")[0] | _cascade("abs(b.d)", "m", "p.")[0], _RSX, also=", x - lag(x) OVER o AS d"),
    "VolumeProfile": _touched(20, 50, _VOLUME, {"price_low": "a", "price_high": "b", "bins": "list_transform(range(1, 51), lambda g: CASE WHEN z IS NULL THEN CASE WHEN g = 1 THEN list_sum(vs) ELSE 0.0 END ELSE z[g] END)"}),
    "TpoProfile": _touched(30, 50, "1.0", {"price_low": "a", "price_high": "b", "counts": "list_transform(range(1, 51), lambda g: CASE WHEN z IS NULL THEN CASE WHEN g = 1 THEN 30.0 ELSE 0.0 END ELSE z[g] END)"}),
    "SinglePrints": _touched(20, 24, "1.0", {"value": "CASE WHEN z IS NULL THEN 0.0 ELSE len(list_filter(z, lambda q: q = 1)) END"}),
    "ProfileShape": _touched(20, 24, _VOLUME, {"value": "CASE WHEN z IS NULL OR list_position(z, list_max(z)) <= 8 THEN -1.0 WHEN list_position(z, list_max(z)) > 16 THEN 1.0 ELSE 0.0 END"}),
    "HighLowVolumeNodes": _touched(20, 24, _VOLUME, {"hvn": "CASE WHEN z IS NULL THEN a ELSE a + (list_position(z, list_max(z)) - 0.5) * t END", "lvn": "CASE WHEN z IS NULL THEN a ELSE a + (list_position(z, list_min(list_filter(z, lambda q: q > 0))) - 0.5) * t END"}),
}


_FAR, _NEAR = "(CASE WHEN p.way > 0 THEN b.high ELSE b.low END)", "(CASE WHEN p.way > 0 THEN b.low ELSE b.high END)"
_ON = f"({_FAR} - p.top) * p.way > 0"
_BACK_5 = f"(NOT ({_ON}) AND ({_NEAR} - p.top * (1 - 0.05 * p.way)) * p.way <= 0)"
#: States of swings that turn by five percent: the extreme so far, its row, the direction; the pivot that a turn confirms.
_SWINGS = (
    {"top": "high", "at": "1", "way": "1", "new": "0", "pp": "0", "pw": "0", "pb": "0"},
    {
        "top": f"CASE WHEN {_ON} THEN {_FAR} WHEN {_BACK_5} THEN {_NEAR} ELSE p.top END", "at": f"CASE WHEN {_ON} OR {_BACK_5} THEN b.i ELSE p.at END", "way": f"CASE WHEN {_BACK_5} THEN -p.way ELSE p.way END",
        "new": _BACK_5, "pp": "p.top", "pw": "p.way", "pb": "p.at",
    },
)


def _swung(need: int, outs: dict[str, str], *stages: dict[str, str]):
    """Outputs on every row once ``need`` pivots are there: x0, x1, ... the last prices, b0, ... their rows, d the last one's
    side, ps all pivots."""
    last = {f"x{k}": f"ps[{k - need}][1]" for k in range(need)} | {f"b{k}": f"ps[{k - need}][3]" for k in range(need)} | {"d": "ps[-1][2]"}
    return _after({k: f"CASE WHEN len(ps) >= {need} THEN {e} END" for k, e in outs.items()}, 1, *_SWINGS, {"ps": "list([pp, pw, pb]) FILTER (new > 0) OVER u"}, last, *stages)


def _shape(need: int, *rules: tuple[str, str]):
    """The side of the first rule that a new pivot and those before it meet."""
    said = " ".join(f"WHEN {rule} THEN {side}" for rule, side in rules)
    return _swung(need, {"value": f"CASE WHEN new = 0 THEN 0.0 {said} ELSE 0.0 END"})


def _same(a: str, b: str, tol: float = 0.03) -> str:
    return f"abs({a} - {b}) <= {tol} * greatest(abs({a}), abs({b}))"


def _leg(a: str, b: str, r: float) -> str:
    return f"{b} + {r} * ({a} - {b})"


def _levels_of(need: int, expr, ratios: tuple[float, ...]):
    return _swung(need, {f"level_{round(r * 1000)}": expr(r) for r in ratios})


def _ratios(**bounds: tuple[float, float]):
    size = {"xa": "abs(x1 - x0)", "ab": "abs(x2 - x1)", "bc": "abs(x3 - x2)", "cd": "abs(x4 - x3)", "ad": "abs(x4 - x1)", "xc": "abs(x3 - x0)"}
    rules = [f"{size[k[:2]]} / nullif({size[k[3:]]}, 0) BETWEEN {lo} AND {hi}" for k, (lo, hi) in bounds.items()]
    return _shape(5, (" AND ".join(rules), "-d"))


_H0, _H1, _L0_, _L1_ = (f"(CASE WHEN d > 0 THEN {a} ELSE {b} END)" for a, b in (("x1", "x0"), ("x3", "x2"), ("x0", "x1"), ("x2", "x3")))
_RETRACED, _EXTENDED, _THIRDS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0), (1.272, 1.414, 1.618, 2.0, 2.618), (0.382, 0.5, 0.618)
_BIGGEST = "list_max(list_filter(range(1, len(ps[-6:])), lambda k: abs(ps[-6:][k][1] - ps[-6:][k + 1][1]) = list_max(list_transform(range(1, len(ps[-6:])), lambda m: abs(ps[-6:][m][1] - ps[-6:][m + 1][1])))))"
_CROWD = "list_transform(z, lambda k: len(list_filter(z, lambda m: abs(m - k) <= 0.03 * greatest(abs(m), abs(k)))))"
_MOST = "list_max(list_filter(range(1, len(z) + 1), lambda k: n[k] = list_max(n)))"
_DRIVES = [f"abs(x{k + 1} - x{k})" for k in range(6)]


def _fibonacci(end: int) -> list[int]:
    out = [1, 2]
    while out[-1] < end:
        out.append(out[-1] + out[-2])
    return out


_ZONES = f"{_fibonacci(10**9)}"


def _fractal(outs: dict[str, str], *stages: dict[str, str]):
    """f: 1 or -1 where the row two before is the only highest or lowest of five; g: which run of one side it belongs to."""
    beside = [k for k in range(5) if k != 2]
    top = " AND ".join(f"lag(high, 2) OVER o > lag(high, {k}) OVER o" for k in beside)
    low = " AND ".join(f"lag(low, 2) OVER o < lag(low, {k}) OVER o" for k in beside)
    return _windows(
        outs, {"top": f"coalesce({top}, false)", "low_": f"coalesce({low}, false)", "h2": "lag(high, 2) OVER o", "l2": "lag(low, 2) OVER o"}, {"f": "CASE WHEN top AND NOT low_ THEN 1 WHEN low_ AND NOT top THEN -1 END"},
        {"before": "last_value(f IGNORE NULLS) OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"}, {"g": "sum(CASE WHEN f IS NOT NULL AND (before IS NULL OR before != f) THEN 1 ELSE 0 END) OVER u"}, *stages,
    )


def _run(back: int) -> dict[str, str]:
    """The extreme of the run that is ``back`` before the present one, and its row."""
    own = f"list_filter(pv, lambda q: q[4] = g - {back})"
    best = f"CASE WHEN ({own})[1][2] > 0 THEN list_max(list_transform({own}, lambda q: q[1])) ELSE list_min(list_transform({own}, lambda q: q[1])) END"
    return {f"v{back}": best, f"r{back}": f"list_filter({own}, lambda q: q[1] = {best})[1][3]"}


_FORK = "((v1 + v0) / 2 - v2) / ((r1 + r0) / 2 - r2)"
_THREE = "(CASE WHEN p.way >= 0 THEN b.close > p.z1 OR b.close < least(p.z1, p.z2, p.z3) ELSE b.close < p.z1 OR b.close > greatest(p.z1, p.z2, p.z3) END)"

SQL |= {
    "ZigZag": _after({"swing": "CASE WHEN new > 0 THEN pp END", "direction": "CASE WHEN new > 0 THEN pw END"}, 1, *_SWINGS),
    "DoubleTopBottom": _shape(3, (_same("x0", "x2"), "-d")),
    "TripleTopBottom": _shape(5, (f"{_same('x0', 'x2')} AND {_same('x2', 'x4')}", "-d")),
    "HeadAndShoulders": _shape(5, (f"{_same('x0', 'x4')} AND {_same('x1', 'x3')} AND (x2 - x0) * d > 0 AND (x2 - x4) * d > 0", "-d")),
    "Triangle": _shape(4, (f"{_same(_H0, _H1)} AND {_L1_} > {_L0_} * 1.03", "1"), (f"{_H1} < {_H0} * 0.97 AND {_same(_L0_, _L1_)}", "-1"), (f"{_H1} < {_H0} * 0.97 AND {_L1_} > {_L0_} * 1.03", "-d")),
    "Wedge": _shape(4, (f"{_H1} > {_H0} AND {_L1_} - {_L0_} > {_H1} - {_H0}", "-1"), (f"{_L1_} < {_L0_} AND {_H1} - {_H0} < {_L1_} - {_L0_}", "1")),
    "FlagPennant": _shape(3, ("x1 != x0 AND abs(x2 - x1) < 0.5 * abs(x1 - x0)", "-d")),
    "RectangleRange": _shape(4, (f"{_same(_H0, _H1)} AND {_same(_L0_, _L1_)}", "-d")),
    "CupAndHandle": _shape(4, (f"{_same('x0', 'x2')} AND least(x1, x2) < x3 AND x3 < greatest(x1, x2) AND (x2 - x1) * -d > 0", "-d")),
    "Abcd": _shape(4, (f"{_DRIVES[1]} / {_DRIVES[0]} BETWEEN 0.382 AND 0.886 AND {_DRIVES[2]} / {_DRIVES[1]} BETWEEN 1.13 AND 2.618 AND {_same(_DRIVES[0], _DRIVES[2], 0.10)}", "-d")),
    "Gartley": _ratios(ab_xa=(0.55, 0.70), bc_ab=(0.382, 0.886), cd_bc=(1.13, 1.618), ad_xa=(0.74, 0.84)),
    "Butterfly": _ratios(ab_xa=(0.74, 0.84), bc_ab=(0.382, 0.886), cd_bc=(1.618, 2.618), ad_xa=(1.27, 1.618)),
    "Bat": _ratios(ab_xa=(0.382, 0.50), bc_ab=(0.382, 0.886), cd_bc=(1.618, 2.618), ad_xa=(0.84, 0.93)),
    "Crab": _ratios(ab_xa=(0.382, 0.618), bc_ab=(0.382, 0.886), cd_bc=(2.24, 3.618), ad_xa=(1.55, 1.65)),
    "Shark": _ratios(ab_xa=(1.13, 1.618), bc_ab=(1.618, 2.24), cd_bc=(0.382, 0.886), ad_xa=(0.886, 1.13)),
    "Cypher": _ratios(ab_xa=(0.382, 0.618), xc_xa=(1.272, 1.414), cd_xc=(0.74, 0.83)),
    "ThreeDrives": _shape(7, (" AND ".join([f"{_DRIVES[k + 1]} / {_DRIVES[k]} BETWEEN 1.13 AND 1.75" for k in (0, 2, 4)] + [_same(_DRIVES[k], _DRIVES[k + 2], 0.20 if k % 2 else 0.30) for k in range(4)]), "-d")),
    "FibRetracement": _levels_of(2, lambda r: _leg("x0", "x1", r), _RETRACED),
    "FibExtension": _levels_of(2, lambda r: f"x0 + {r} * (x1 - x0)", _EXTENDED),
    "FibProjection": _levels_of(3, lambda r: f"x2 + {r} * (x1 - x0)", (0.618, 1.0, 1.618, 2.618)),
    "AutoFib": _swung(2, {f"level_{round(r * 1000)}": _leg("u0", "u1", r) for r in _RETRACED}, {"j": _BIGGEST}, {"u0": "ps[-6:][j][1]", "u1": "ps[-6:][j + 1][1]"}),
    "GoldenPocket": _swung(2, {"low": f"least({_leg('x0', 'x1', 0.618)}, {_leg('x0', 'x1', 0.65)})", "mid": f"({_leg('x0', 'x1', 0.618)} + {_leg('x0', 'x1', 0.65)}) / 2", "high": f"greatest({_leg('x0', 'x1', 0.618)}, {_leg('x0', 'x1', 0.65)})"}),
    "FibConfluence": _swung(3, {"price": "list_avg(list_filter(z, lambda m: abs(m - z[j]) <= 0.03 * greatest(abs(m), abs(z[j]))))", "strength": "list_max(n)"},
        {"z": "flatten(list_transform(range(1, len(ps[-6:])), lambda k: list_transform([0.382, 0.5, 0.618], lambda r: ps[-6:][k + 1][1] + CAST(r AS DOUBLE) * (ps[-6:][k][1] - ps[-6:][k + 1][1]))))"}, {"n": _CROWD}, {"j": _MOST}),
    "FibFan": _swung(2, {f"fan_{round(r * 1000)}": f"x0 + {r} * (x1 - x0) * (i - b0) / (b1 - b0)" for r in _THIRDS}),
    "FibArcs": _swung(2, {f"arc_{round(r * 1000)}": f"x1 + (x0 - x1) * {r} * sqrt(greatest(0.0, 1 - pow((i - b1) / (b1 - b0), 2)))" for r in _THIRDS}),
    "FibChannel": _swung(3, {"base": "line"} | {f"level_{round(r * 1000)}": f"line + {r} * (x1 - (x0 + slope * (b1 - b0)))" for r in (0.618, 1.0, 1.618)}, {"slope": "(x2 - x0) / (b2 - b0)"}, {"line": "x0 + slope * (i - b0)"}),
    "FibTimeZones": _swung(1, {"on_zone": f"CASE WHEN list_contains({_ZONES}, CAST(i - b0 AS BIGINT)) THEN 1.0 ELSE 0.0 END", "bars_to_next": f"list_min(list_filter({_ZONES}, lambda k: k > i - b0)) - (i - b0)"}),
    "TdDWave": _fractal({"value": "CASE WHEN g > 0 THEN (g - 1) % 8 + 1 END"}),
    "AndrewsPitchfork": _fractal({"median": f"CASE WHEN g >= 3 THEN v2 + {_FORK} * (i - r2) END", "upper": f"CASE WHEN g >= 3 THEN greatest(v1 + {_FORK} * (i - r1), v0 + {_FORK} * (i - r0)) END", "lower": f"CASE WHEN g >= 3 THEN least(v1 + {_FORK} * (i - r1), v0 + {_FORK} * (i - r0)) END"},
        {"pv": "list([CASE WHEN f > 0 THEN h2 ELSE l2 END, f, i - 2, g]) FILTER (f IS NOT NULL) OVER u"}, _run(0) | _run(1) | _run(2)),
    "ThreeLineBreak": _steps(1, {"z1": "close", "z2": "NULL", "z3": "NULL", "way": "0"}, {"z1": f"CASE WHEN {_THREE} THEN b.close ELSE p.z1 END", "z2": f"CASE WHEN {_THREE} THEN p.z1 ELSE p.z2 END", "z3": f"CASE WHEN {_THREE} THEN p.z2 ELSE p.z3 END",
        "way": f"CASE WHEN {_THREE} THEN sign(b.close - p.z1) ELSE p.way END"}, {"value": "CASE WHEN way != 0 THEN way END"}),
}


def _quadrature(first: str, buffer: str) -> str:
    """The transform over a buffer of which p holds the values before, the newest being ``first``."""
    return f"((0.0962 * {first} + 0.5769 * {buffer.format(1, 2)} - 0.5769 * {buffer.format(3, 4)} - 0.0962 * {buffer.format(5, 6)}) * _GAIN)"


def _hilbert() -> tuple[dict[str, str], dict[str, str]]:
    """States of the transform: last detrended values (d), quadratures (q) and in-phase values (j), what the period is made
    of, the period and its average (sp); ph, m, f: phase and both averages that follow it."""
    gain = "(0.075 * least(greatest(p.per, 6), 50) + 0.54)"
    d0 = _quadrature("b.sm", "b.x{1}")
    q0 = _quadrature(d0, "p.d{0}")
    j0 = "(CASE WHEN p.d5 IS NOT NULL THEN p.d2 END)"
    ready = "(p.q5 IS NOT NULL)"
    i2 = f"(0.2 * ({j0} - {_quadrature(q0, 'p.q{0}')}) + 0.8 * p.i2)"
    q2 = f"(0.2 * ({q0} + {_quadrature(j0, 'p.j{0}')}) + 0.8 * p.q2_)"
    re = f"(0.2 * ({i2} * p.i2 + {q2} * p.q2_) + 0.8 * p.re)"
    im = f"(0.2 * ({i2} * p.q2_ - {q2} * p.i2) + 0.8 * p.im)"
    raw = f"(CASE WHEN abs({im}) > 2.220446049250313e-16 AND abs({re}) > 2.220446049250313e-16 THEN 2 * pi() / atan2({im}, {re}) ELSE p.per END)"
    per = f"(0.2 * least(greatest(greatest(least({raw}, 1.5 * p.per), 0.67 * p.per), 6), 50) + 0.8 * p.per)"
    phase = f"(CASE WHEN abs({j0}) > 2.220446049250313e-16 THEN degrees(atan({q0} / {j0})) ELSE p.ph END)"
    k = f"least(greatest(0.5 / greatest(p.ph - {phase}, 1), 0.05), 0.5)"
    m = f"({k} * b.x + (1 - {k}) * p.m)"
    step = {"d0": d0, "q0": q0, "j0": j0} | {f"{n}{z}": f"p.{n}{z - 1}" for n in "dqj" for z in range(1, 7)}
    step |= {n: f"CASE WHEN {ready} THEN {e} ELSE p.{n} END" for n, e in {"i2": i2, "q2_": q2, "re": re, "im": im, "per": per, "sp": f"0.33 * {per} + 0.67 * p.sp", "ph": phase, "m": m, "f": f"0.5 * {k} * {m} + (1 - 0.5 * {k}) * p.f"}.items()}
    start = {"d0": d0.replace("_GAIN", "0.99").replace("b.", "")} | {n: "NULL" for n in step if n[0] in "dqj" and n not in ("d0", "q2_")} | {n: "0" for n in ("i2", "q2_", "re", "im", "per", "sp", "ph")} | {"m": "sm1", "f": "sm1"}
    return {n: start[n] for n in step}, {n: e.replace("_GAIN", gain) for n, e in step.items()}


_HILBERT = _hilbert()
_SMOOTHED = _staged({f"x{k}": f"lag(x, {k}) OVER o" for k in range(1, 7)}, {"sm": "(4 * x + 3 * x1 + 2 * x2 + x3) / 10"}, {"sm1": "lag(sm) OVER o"})


def _cycle(outs: dict[str, str], first: int, *stages: dict[str, str]):
    return _after({k: _from(first, e) for k, e in outs.items()}, 7, *_HILBERT, *stages, source=_SMOOTHED)


_TURNED = "list_sum(list_transform(range(0, least(n, len(w))), lambda k: {0}(2 * pi() * k / n) * w[len(w) - k]))"

SQL |= {
    "HtPhasor": _cycle({"inphase": "d3", "quadrature": "q0"}, 19),
    "HilbertDominantCycle": _cycle({"value": "sp"}, 50),
    "AdaptiveCycle": _cycle({"value": "least(25, greatest(3, round(0.5 * sp)))"}, 50),
    "Mama": _cycle({"mama": "m", "fama": "f"}, 33),
    "Fama": _cycle({"value": "f"}, 33),
    "HtDcPhase": _cycle({"value": "CASE WHEN a > 315 THEN a - 360 ELSE a END"}, 50, {"w": f"list(sm) FILTER (i >= 7) {_rows(50)}", "n": "CAST(floor(sp + 0.5) AS INTEGER)"}, {"s": f"CASE WHEN i >= 50 THEN {_TURNED.format('sin')} END", "c": f"CASE WHEN i >= 50 THEN {_TURNED.format('cos')} END"},
        {"a": "CASE WHEN c != 0 THEN degrees(atan(s / c)) WHEN s >= 0 THEN 90 ELSE -90 END + 90 + 360 / nullif(sp, 0) + CASE WHEN c < 0 THEN 180 ELSE 0 END"}),
}


def _passed_band(source: str) -> str:
    """The source with bp, its band-passed x, and u, the middle of the last ten of these."""
    carried = _steps(2, {"y": "0", "yb": "0"}, _band_pass(0.5 * math.pi / 20, 20), {"value": "0"}, also=_BEFORE)(source, "q", 6).rsplit("\nSELECT", 1)[0]
    return f"SELECT *, (max(bp) {_rows(10)} + min(bp) {_rows(10)}) / 2 AS u FROM ({carried} SELECT sym, ts, coalesce(y, 0) AS bp FROM e) s"


_TREND = "(CASE WHEN b.i = 11 THEN b.u ELSE {0!r} * (b.u + p.u) / 2 + {1!r} * p.m + {2!r} * p.mb END)".format(*_smoother(20))
_MODE = f"CASE WHEN b.i = 11 THEN b.bp - {_TREND} ELSE {{0!r}} * (b.bp - {_TREND} + p.bp - p.m) / 2 + {{1!r}} * p.z + {{2!r}} * p.zb END".format(*_smoother(20))

SQL |= {
    "EmpiricalModeDecomposition": _steps(10, {"m": "u", "mb": "0", "z": "bp - u", "zb": "0"}, {"m": _TREND, "mb": "p.m", "z": _MODE, "zb": "p.z"}, {"value": "z"}, source=_passed_band("{source}")),
}



def _bars(first: dict[str, str], step: dict[str, str], fields: dict[str, str], also: str = ""):
    """Bars of which a row closes one at most; done: whether it does."""

    def sql(source: str) -> str:
        carried = _steps(1, first | {"done": first.get("done", "0")}, step, {"value": "0"}, also=also)(source, "q", 6).rsplit("\nSELECT", 1)[0]
        return carried + f"\nSELECT sym, ts, CAST(0 AS INTEGER) AS bar, {', '.join(f'{e} AS {k}' for k, e in fields.items())} FROM e WHERE done > 0"

    return sql


def _gathered(first: dict[str, str], step: dict[str, str], fields: dict[str, str], also: str = ""):
    ohlc = {"bo": "CASE WHEN p.done > 0 THEN b.open ELSE p.bo END", "bh": "CASE WHEN p.done > 0 THEN b.high ELSE greatest(p.bh, b.high) END", "bl": "CASE WHEN p.done > 0 THEN b.low ELSE least(p.bl, b.low) END"}
    return _bars({"bo": "open", "bh": "high", "bl": "low"} | first, ohlc | step, {"open": "bo", "high": "bh", "low": "bl", "close": "close"} | fields, also)


def _kept(state: str, when: str = "p.done > 0") -> str:
    return f"(CASE WHEN {when} THEN 0 ELSE p.{state} END)"


_SIGN = ", coalesce(sign(close - lag(close) OVER o), 0) AS g"
_THETA = f"({_kept('theta')} + (CASE WHEN b.g != 0 THEN b.g ELSE p.sg END))"
_RUN_ON = f"(b.g = 0 OR b.g = {_kept('sg')})"
_RUN_K = f"(CASE WHEN {_RUN_ON} THEN {_kept('k')} + CASE WHEN {_kept('sg')} != 0 THEN 1 ELSE 0 END ELSE 1 END)"
_RUN_SIGN = f"(CASE WHEN {_RUN_ON} THEN {_kept('sg')} ELSE b.g END)"
_BACK = "(p.way != 0 AND (p.far - b.close) * p.way >= 20)"
_BOX = "floor(b.close / 20) * 20"
_FLIP = f"((p.way > 0 AND {_BOX} <= p.tp - 60) OR (p.way < 0 AND {_BOX} >= p.lw + 60))"
_LINE = "(CASE WHEN p.d = 0 THEN b.close != p.c1 WHEN (b.close - p.c1) * p.d > 0 THEN true WHEN p.d > 0 THEN b.close < least(p.o1, p.o2, p.o3, p.c1, p.c2, p.c3) ELSE b.close > greatest(p.o1, p.o2, p.o3, p.c1, p.c2, p.c3) END)"


def _line(new: str, old: str) -> str:
    return f"CASE WHEN {_LINE} THEN {new} ELSE p.{old} END"


def _footprint(source: str) -> str:
    bucket = "floor({0}.price / 50) * 50"
    return (
        f"WITH c AS ({source}),\nf AS (SELECT a.sym, a.ts, {bucket.format('b')} AS price, sum(CASE WHEN b.side > 0 THEN 0.0 ELSE b.size END) AS bid_volume, sum(CASE WHEN b.side > 0 THEN b.size ELSE 0.0 END) AS ask_volume\n"
        f"FROM c a JOIN c b ON a.sym = b.sym AND b.ts <= a.ts GROUP BY a.sym, a.ts, {bucket.format('b')})\n"
        "SELECT sym, ts, CAST(row_number() OVER (PARTITION BY sym, ts ORDER BY price) - 1 AS INTEGER) AS bar, price, bid_volume, ask_volume FROM f"
    )


#: Bars with the sizes of the driver's queries, as functions of their source.
BARS = {
    "VolumeBars": _gathered({"bv": "volume", "done": "volume >= 50"}, {"bv": f"{_kept('bv')} + b.volume", "done": f"{_kept('bv')} + b.volume >= 50"}, {"volume": "bv"}),
    "DollarBars": _gathered(
        {"bv": "volume", "bd": "close * volume", "done": "close * volume >= 2000"}, {"bv": f"{_kept('bv')} + b.volume", "bd": f"{_kept('bd')} + b.close * b.volume", "done": f"{_kept('bd')} + b.close * b.volume >= 2000"}, {"volume": "bv", "dollar": "bd"}
    ),
    "ImbalanceBars": _gathered({"sg": "0", "theta": "0"}, {"sg": "CASE WHEN b.g != 0 THEN b.g ELSE p.sg END", "theta": _THETA, "done": f"abs({_THETA}) >= 5"}, {"imbalance": "theta", "direction": "sign(theta)"}, _SIGN),
    "RunBars": _gathered({"sg": "0", "k": "0"}, {"sg": _RUN_SIGN, "k": _RUN_K, "done": f"{_RUN_SIGN} != 0 AND {_RUN_K} >= 3"}, {"length": "k", "direction": "sg"}, _SIGN),
    "KagiBars": _bars(
        {"st": "close", "far": "close", "way": "0", "es": "0", "ee": "0"},
        {
            "st": f"CASE WHEN {_BACK} THEN p.far ELSE p.st END", "far": f"CASE WHEN p.way = 0 OR {_BACK} OR (b.close - p.far) * p.way > 0 THEN b.close ELSE p.far END",
            "way": f"CASE WHEN p.way = 0 THEN sign(b.close - p.far) WHEN {_BACK} THEN -p.way ELSE p.way END", "es": "p.st", "ee": "p.far", "done": _BACK,
        },
        {"start": "es", '"end"': "ee", "direction": "-way"},
    ),
    "PointAndFigureBars": _bars(
        {"tp": "floor(close / 20) * 20", "lw": "floor(close / 20) * 20", "way": "0", "et": "0", "el": "0"},
        {
            "tp": f"CASE WHEN p.way = 0 AND {_BOX} >= p.tp + 20 OR p.way > 0 AND {_BOX} > p.tp THEN {_BOX} WHEN {_FLIP} AND p.way > 0 THEN p.tp - 20 WHEN {_FLIP} THEN {_BOX} ELSE p.tp END",
            "lw": f"CASE WHEN p.way = 0 AND {_BOX} <= p.lw - 20 OR p.way < 0 AND {_BOX} < p.lw THEN {_BOX} WHEN {_FLIP} AND p.way < 0 THEN p.lw + 20 WHEN {_FLIP} THEN {_BOX} ELSE p.lw END",
            "way": f"CASE WHEN p.way = 0 THEN (CASE WHEN {_BOX} >= p.tp + 20 THEN 1 WHEN {_BOX} <= p.lw - 20 THEN -1 ELSE 0 END) WHEN {_FLIP} THEN -p.way ELSE p.way END", "et": "p.tp", "el": "p.lw", "done": _FLIP,
        },
        {"direction": "-way", "high": "et", "low": "el"},
    ),
    "ThreeLineBreakBars": _bars(
        {"o1": "NULL", "c1": "close", "o2": "NULL", "c2": "NULL", "o3": "NULL", "c3": "NULL", "d": "0"},
        {"o1": _line("p.c1", "o1"), "c1": _line("b.close", "c1"), "o2": _line("p.o1", "o2"), "c2": _line("p.c1", "c2"), "o3": _line("p.o2", "o3"), "c3": _line("p.c2", "c3"), "d": _line("sign(b.close - p.c1)", "d"), "done": _LINE},
        {"open": "o1", "close": "c1", "direction": "d"},
    ),
    "Footprint": _footprint,
}


def _moved(start: str, n: str, way: str) -> str:
    """start and n boxes of 20 added one by one."""
    return f"list_reduce(list_prepend({start}, list_transform(range(0, CAST({n} AS BIGINT)), lambda q: 20.0 * {way})), lambda u, v: u + v)"


def _bricks(first: str, n: str):
    """n bricks a row from the level ``first`` on, toward the close."""

    def sql(source: str) -> str:
        way = "sign(b.close - p.a)"
        start = {"a": "close", "way": "0", "n": "0", "s": "close"}
        step = {"a": f"CASE WHEN {n} > 0 THEN {_moved(first, n, way)} ELSE p.a END", "way": f"CASE WHEN {n} > 0 THEN {way} ELSE p.way END", "n": n, "s": first}
        carried = _steps(1, start, step, {"value": "0"})(source, "q", 6).rsplit("\nSELECT", 1)[0]
        return (
            f"{carried},\nk AS (SELECT sym, ts, way, s, unnest(range(0, CAST(n AS BIGINT))) AS k FROM e WHERE n > 0)\n"
            f"SELECT sym, ts, CAST(k AS INTEGER) AS bar, {_moved('s', 'k', 'way')} AS open, {_moved('s', 'k + 1', 'way')} AS close, way AS direction FROM k"
        )

    return sql


_BOXES = "floor(abs(b.close - p.a) / 20)"
_WITH = "(p.way = 0 OR p.way = sign(b.close - p.a))"
BARS |= {
    "RangeBars": _bricks("p.a", _BOXES),
    "RenkoBars": _bricks(f"CASE WHEN {_WITH} THEN p.a ELSE p.a + 20.0 * sign(b.close - p.a) END", f"(CASE WHEN {_WITH} THEN {_BOXES} ELSE greatest({_BOXES} - 1, 0) END)"),
}


#: Not one operator: the mean of five values of the relative strength index.
CHAIN = _windows({"value": _from(19, "v")}, _DIFF, _GAIN, {"q": _from(15, f"100 * {_ema('g[2:]', 14, 1 / 14)} / ({_ema('g[2:]', 14, 1 / 14)} + {_ema('f[2:]', 14, 1 / 14)})")}, {"v": "avg(q) OVER (PARTITION BY sym ORDER BY ts ROWS 4 PRECEDING)"})
