"""All operators: the array evaluation against one-row-at-a-time stepping, and hand-computed values."""

import math
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from series import columns

from tidemark.operators import OPERATORS, catalog
from tidemark.operators.bars import BARS
from tidemark.plans.expr import Stepper, evaluate
from tidemark.plans.spark import flat

COLS = columns()
#: Operators by family; 12 of microstructure, 7 book operators and 11 builders (10 bars, the footprint) beside these make 514.
FAMILIES = {
    "Moving Averages": 26, "Momentum Oscillators": 34, "Trend & Directional": 28, "Price Oscillators": 14, "Volatility & Bands": 25, "Bands & Channels": 16, "Trailing Stops": 19, "Volume": 26, "Price Statistics": 55,
    "Ehlers / Cycle": 29, "Pivots & S/R": 12, "DeMark": 19, "Ichimoku & Charts": 7, "Candlestick Patterns": 66, "Derivatives": 17, "Market Profile": 10, "Risk / Performance": 28, "Market Breadth": 15,
    "Seasonality & Session": 12, "Chart Patterns": 8, "Harmonic Patterns": 8, "Fibonacci": 10,
}


def run(name, cols=COLS, **params):
    outs = OPERATORS[name].outputs(**params)
    n = len(next(iter(cols.values())))
    return dict(zip(outs, evaluate(flat(outs), cols, n), strict=True))


def test_catalogue():
    count = {}
    for op in OPERATORS.values():
        count[op.family] = count.get(op.family, 0) + 1
    for family, n in FAMILIES.items():
        assert count[family] == n, family
    assert count["Microstructure"] == 12 and len(BARS) == 11


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_stepping_equals_arrays_and_is_causal(name):
    n = 70
    outs = flat(OPERATORS[name].outputs())
    cols = {k: v[:n] for k, v in COLS.items()}
    whole = evaluate(outs, cols, n)
    stepper = Stepper(outs)
    rows = np.array([stepper.step({k: float(v[i]) for k, v in cols.items()}) for i in range(n)]).T
    for a, b in zip(whole, rows, strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)
    early = evaluate(outs, {k: v[:40] for k, v in COLS.items()}, 40)
    for a, b in zip(whole, early, strict=True):
        assert np.allclose(a[:40], b, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_known_values():
    x = {"x": np.array([1.0, 2, 3, 4, 5, 6])}
    assert np.allclose(run("Sma", x, period=3)["value"], [np.nan, np.nan, 2, 3, 4, 5], equal_nan=True)
    assert np.allclose(run("Ema", x, period=3)["value"], [np.nan, np.nan, 2, 3, 4, 5], equal_nan=True)
    assert np.allclose(run("Wma", x, period=3)["value"][2:], [14 / 6, 20 / 6, 26 / 6, 32 / 6])
    assert run("Rsi", x, period=3)["value"][-1] == 100
    assert run("Roc", x, period=2)["value"][2] == 200
    assert np.allclose(run("LinRegSlope", x, period=4)["value"][3:], 1)
    assert np.allclose(run("StdDev", x, period=3)["value"][2:], math.sqrt(2 / 3))
    flat_ = {"x": np.full(6, 5.0)}
    assert run("Rsi", flat_, period=3)["value"][-1] == 50
    assert run("PercentB", flat_, period=3)["value"][-1] == 0.5
    assert run("ZScore", flat_, period=3)["value"][-1] == 0
    bar = {k: np.array([v]) for k, v in {"open": 10.0, "high": 10.2, "low": 7.0, "close": 10.1, "volume": 1.0}.items()}
    assert run("Hammer", bar)["value"][0] == 1 and run("HangingMan", bar)["value"][0] == -1
    assert run("TrueRange", bar)["value"][0] == pytest.approx(3.2) and run("Obv", bar)["value"][0] == 0


def test_profit_factor_is_infinite_without_losses():
    assert run("ProfitFactor", {"x": np.array([1.0, 2.0])}, period=2)["value"][1] == math.inf


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        catalog.get("Sma").outputs(period=0)
    with pytest.raises(ValueError):
        catalog.get("Sma").outputs(length=3)
    with pytest.raises(KeyError):
        catalog.get("Nothing")
    with pytest.raises(ValueError):
        BARS["RenkoBars"].make(box_size=0)


def test_bars():
    step = BARS["RenkoBars"].make(box_size=2.0)
    assert [step(p) for p in (10.0, 14.5, 11.0, 9.9)] == [[], [(10, 12, 1), (12, 14, 1)], [], [(12, 10, -1)]]
    step = BARS["RangeBars"].make(range_=1.0)
    assert [len(step(p)) for p in (5.0, 7.2, 6.5, 5.9)] == [0, 2, 0, 1]
    step = BARS["VolumeBars"].make(volume_per_bar=10.0)
    assert [step(1.0, 2.0, 0.5, 1.5, v) for v in (6.0, 6.0, 6.0)] == [[], [(1.0, 2.0, 0.5, 1.5, 12.0)], []]
    step = BARS["Footprint"].make(tick_size=1.0)
    step(10.2, 3.0, 1.0)
    assert step(10.7, 2.0, -1.0) == [(10.0, 2.0, 3.0)]
