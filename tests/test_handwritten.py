"""Spark results of market operators against SQL written by hand, and what is refused."""

import duckdb
import pytest

from tidemark import queries
from tidemark.operators import OPERATORS
from tidemark.plans import handwritten
from tidemark.sources.candles import read_candles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(handwritten.SQL))
def test_same_values(spark, con, name):
    want = con.sql(queries.oracles()[f"ind_{queries.snake(name)}"])
    names = want.columns
    got = queries.QUERIES[f"ind_{queries.snake(name)}"](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = {(r["sym"], r["ts"]): tuple(r[c] for c in names) for r in got.collect()}
    expected = {(r[names.index("sym")], r[names.index("ts")]): r for r in want.fetchall()}
    assert rows.keys() == expected.keys()
    for k, r in rows.items():
        for a, b in zip(r, expected[k], strict=True):
            assert a == b or a == pytest.approx(b, abs=2e-6, rel=1e-12), (k, r, expected[k])


@pytest.mark.parametrize("name", [*(f"bars_{queries.snake(n)}" for n in handwritten.BARS), "bars_tick_bars", "ind_depth_slope", "ind_order_flow_imbalance"])
def test_same_bars_and_books(spark, con, name):
    want = con.sql(queries.oracles()[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    places = [want.columns.index(c) for c in ("sym", "ts", "bar") if c in want.columns]
    by = lambda rows: sorted(rows, key=lambda r: [r[i] for i in places])
    rows, expected = by([tuple(r[c] for c in want.columns) for r in got.collect()]), by(want.fetchall())
    assert len(rows) == len(expected) > 0
    for a, b in zip(rows, expected, strict=True):
        assert all(x == y or x == pytest.approx(y, abs=2e-6, rel=1e-12) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize(
    "name, params",
    [
        ("Garch11", {"omega": 2.0, "alpha": 0.5, "beta": 0.5}), ("Garch11", {"omega": 0.0}), ("VarianceRatio", {"period": 3, "q": 7}), ("Rsi", {"period": 0}), ("Sma", {"period": -3}), ("Sma", {"period": 2.5}), ("Ema", {"period": "x"}),
        ("RollingQuantile", {"period": 14, "quantile": 2.0}), ("T3", {"v": 2.0}), ("LaguerreRsi", {"gamma": 2.0}), ("EwmaVolatility", {"decay": 2.0}), ("PairwiseBeta", {"period": 1}), ("PairSpreadZScore", {"beta_period": 1}),
        ("LeadLagCrossCorrelation", {"window_": 1}), ("LeadLagCrossCorrelation", {"max_lag": 0}), ("MacdIndicator", {"fast": 26, "slow": 12}), ("BollingerBands", {"multiplier": float("nan")}), ("SuperTrend", {"multiplier": 0.0}),
        ("Psar", {"af_start": 0.5}), ("KRatio", {"period": 2}), ("ValueAtRisk", {"confidence": 1.0}), ("Sma", {"length": 3}),
    ],
)
def test_refused_parameters(name, params):
    with pytest.raises(ValueError):
        OPERATORS[name].outputs(**params)


def test_defaults_are_accepted():
    for op in OPERATORS.values():
        op.outputs()


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,open,high,low,close,volume\n1,2,4,1,3,10\n")
    (tmp_path / "b.csv").write_text("timestamp,open,high,low,close,volume\n2,3,5,2,4,11\n")
    assert sorted(map(tuple, read_candles(spark, str(tmp_path)).collect())) == [(1, 2.0, 4.0, 1.0, 3.0, 10.0), (2, 3.0, 5.0, 2.0, 4.0, 11.0)]
    (tmp_path / "c.csv").write_text("timestamp,high,open,low,close,volume\n3,5,3,2,4,11\n")
    with pytest.raises(Exception, match="header"):
        read_candles(spark, str(tmp_path)).collect()
