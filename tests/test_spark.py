"""DataFrame plans against arrays and DuckDB, on two keys in mixed order with a row that has no input."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from series import candles, columns

from tidemark.functions import books
from tidemark.operators import OPERATORS
from tidemark.plans.emit import build_bars
from tidemark.plans.expr import evaluate
from tidemark.plans.spark import FN, Compiler, apply, flat, is_native, named
from tidemark.plans.sql import query
from tidemark.queries import QUERIES, oracles
from tidemark.sources import candles as shape
from tidemark.streaming.runner import stream_candles, stream_operator

GAP = 37
NATIVE = ["Ema", "Rsi", "Adx", "T3", "BollingerBands", "Aroon", "Obv", "Vwap", "Mfi", "LinRegSlope", "Skewness", "MedianMa", "Alma", "Beta", "Engulfing", "OpeningRange", "ProfitFactor", "Vzo", "FundingRateZScore", "Trin", "UlcerIndex"]
KERNEL = ["Kama", "Psar", "SuperTrend", "HurstExponent", "Gartley", "FibRetracement", "SessionVwap", "VolumeProfile", "Mama"]


def panel():
    parts = []
    for key, scale in (("a", 1.0), ("b", 1.3)):
        d = pd.DataFrame(columns(scale=scale))
        d["sym"], d["seq"] = key, np.arange(len(d))
        parts.append(d)
    d = pd.concat(parts, ignore_index=True)
    hole = (d.sym == "b") & (d.seq == GAP)
    d.loc[hole, [c for c in d.columns if c not in ("ts", "sym", "seq")]] = np.nan
    return d


@pytest.fixture(scope="module")
def frames(spark):
    d = panel()
    return d, spark.createDataFrame(d.sample(frac=1, random_state=3)).repartition(3).cache()


def expected(d, name, key):
    src = d[d.sym == key]
    ok = src.x.notna().to_numpy()
    outs = flat(OPERATORS[name].outputs())
    got = []
    for a in evaluate(outs, {k: src[k].to_numpy()[ok] for k in src.columns if k != "sym"}, int(ok.sum())):
        full = np.full(len(src), np.nan)
        full[ok] = a
        got.append(full)
    return got


def compare(d, got, name, prefix="o"):
    outs = named(OPERATORS[name].outputs(), prefix)
    got = got.sort_values(["sym", "seq"])
    for key in "ab":
        mine = got[got.sym == key]
        values = []
        for k, v in outs.items():
            values += [mine[k].map(lambda r, i=i: np.nan if r is None else r[i]).astype(float) for i in range(len(v))] if isinstance(v, list) else [mine[k].astype(float)]
        for a, b in zip(values, expected(d, name, key), strict=True):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-8, equal_nan=True), (name, key)


@pytest.mark.parametrize("name", NATIVE)
def test_native_plan(frames, name):
    d, df = frames
    assert is_native(flat(OPERATORS[name].outputs())) or name == "Aroon"
    got = apply(df, name, key="sym", order=["ts", "seq"], out="o").toPandas()
    compare(d, got, name)
    if name == "Aroon":
        return
    clean = d[d.x.notna()]  # noqa: F841  read by DuckDB
    e = duckdb.sql(query("SELECT * FROM clean", name, "sym", "seq", out="o")).df()
    m = got.merge(e, on=["sym", "seq"], suffixes=("", "_sql"))
    for k in named(OPERATORS[name].outputs(), "o"):
        assert np.allclose(m[k].astype(float), m[f"{k}_sql"].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True), name


def test_native_plan_has_no_python_and_one_exchange(frames):
    _, df = frames
    plan = apply(df, "MacdIndicator", key="sym", order=["ts", "seq"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") <= 6
    # an average of an average: one sort for the rows, one for the blocks of each
    plan = apply(df, "Dema", key="sym", order=["ts", "seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 3


def test_conditions_are_strict_and_named_once(spark):
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    a, b = F.col("left"), F.col("right")
    got = spark.createDataFrame(rows, "left boolean, right boolean").select(a, b, FN["and"](a, b), FN["or"](a, b)).collect()
    for x, y, both, either in got:
        assert (both, either) == ((None, None) if x is None or y is None else (x and y, x or y))
    assert str(FN["and"](a, b)).count("left") == str(FN["or"](a, b)).count("left") == 1


@pytest.mark.parametrize("name", ["FallingThreeMethods", "RisingThreeMethods"])
def test_long_chain_of_conditions(frames, name):
    """Its expression grows with the number of conditions, not with 2 to that power."""
    d, df = frames
    column = Compiler(df.withColumn("_valid", F.lit(True)), ["sym"], ["ts"], {k: k for k in ("open", "high", "low", "close")}).run(flat(OPERATORS[name].outputs()))[0]
    assert len(str(column)) < 20_000
    compare(d, apply(df, name, key="sym", order=["ts", "seq"], out="o").toPandas(), name)


@pytest.mark.parametrize("name", KERNEL)
def test_kernel_plan(frames, name):
    d, df = frames
    compare(d, apply(df, name, key="sym", order=["ts", "seq"], out="o").toPandas(), name)


@pytest.mark.parametrize("name", ["Ema", "Psar"])
def test_bounded_plan(frames, name):
    d, df = frames
    compare(d, apply(df, name, key="sym", order=["ts", "seq"], out="o", bounded=True).toPandas(), name)


def test_long_decay_over_several_blocks(spark):
    n = 700
    x = np.cumsum(np.random.default_rng(1).normal(size=n))
    df = spark.createDataFrame(pd.DataFrame({"sym": "a", "ts": np.arange(n), "x": x}))
    got = apply(df, "Ema", key="sym", order=["ts"], period=2, out="o").orderBy("ts").toPandas()["o"].astype(float)
    assert np.allclose(got, evaluate(flat(OPERATORS["Ema"].outputs(period=2)), {"x": x}, n)[0], rtol=1e-12, equal_nan=True)


def test_apply_checks_columns(frames):
    with pytest.raises(ValueError):
        apply(frames[1].drop("close"), "Atr", key="sym", order=["ts"])


def test_bar_builder(frames):
    d, df = frames
    got = build_bars(df, "TickBars", key="sym", order=["ts", "seq"], ticks=10).toPandas()
    assert got.groupby("sym").size().to_dict() == {"a": 9, "b": 8}
    first = got[(got.sym == "a")].sort_values("seq").iloc[0]
    src = d[d.sym == "a"].iloc[:10]
    assert first.high == src.high.max() and first.close == src.close.iloc[-1] and first.volume == pytest.approx(src.volume.sum())


def test_books(spark):
    df = spark.sql("SELECT array(named_struct('price', 9D, 'size', 3D), named_struct('price', 8D, 'size', 1D)) AS bids, array(named_struct('price', 11D, 'size', 1D), named_struct('price', 12D, 'size', 3D)) AS asks")
    row = df.select(*[f(F.col("bids"), F.col("asks")).alias(k) for k, f in books.BOOKS.items()]).first()
    assert row["OrderBookImbalanceTop1"] == 0.5 and row["OrderBookImbalanceFull"] == 0 and row["Microprice"] == pytest.approx(10.5)
    assert row["QuotedSpread"] == pytest.approx(2000) and row["DepthSlope"] == pytest.approx(2.0)


def test_ticks_resample_fill_and_anchor(spark):
    ticks = spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 999, 3.0, 1.0), ("a", 500, 0.5, 2.0), ("a", 3000, 2.0, 1.0), ("a", -1, 7.0, 1.0)], "sym string, ts long, price double, volume double")
    c = shape.ticks_to_candles(ticks, 1000, key="sym")
    got = [tuple(r) for r in c.orderBy("ts").collect()]
    assert got == [("a", -1000, 7.0, 7.0, 7.0, 7.0, 1.0), ("a", 0, 1.0, 3.0, 0.5, 3.0, 4.0), ("a", 3000, 2.0, 2.0, 2.0, 2.0, 1.0)]
    filled = [(r.ts, r.close, r.volume) for r in shape.fill_gaps(c, 1000, key="sym").orderBy("ts").collect()]
    assert filled == [(-1000, 7.0, 1.0), (0, 3.0, 4.0), (1000, 3.0, 0.0), (2000, 3.0, 0.0), (3000, 2.0, 1.0)]
    big = [tuple(r) for r in shape.resample(c, 2000, key="sym").orderBy("ts").collect()]
    assert big == [("a", -2000, 7.0, 7.0, 7.0, 7.0, 1.0), ("a", 0, 1.0, 3.0, 0.5, 3.0, 4.0), ("a", 2000, 2.0, 2.0, 2.0, 2.0, 1.0)]
    seg = shape.anchored(c.withColumn("f", F.col("ts") == 0), "f", key="sym", order=["ts"]).orderBy("ts").collect()
    assert [r.segment for r in seg] == [0, 1, 1]
    with pytest.raises(Exception, match="time goes back"):
        shape.in_order(ticks.withColumn("seq", F.monotonically_increasing_id()).coalesce(1), key="sym").collect()


@pytest.fixture(scope="module")
def odd_events(spark, tmp_path_factory):
    """Ticks at one time that differ, first and last in an hour; hours whose first, last or only value is missing; no time; no type; gaps."""
    us = 1_000_000
    rows = [(0, 5 * us, "a", 1.0), (1, 5 * us, "a", 2.0), (2, 5 * us + 1, "a", 9.0), (3, 3599 * us, "a", 3.0), (4, 3599 * us, "a", 4.0), (5, 3599 * us, "a", 2.5)]
    rows += [(6, 3600 * us, "a", None), (7, 3601 * us, "a", 6.0), (8, 3602 * us, "a", 5.0), (9, 3603 * us, "a", None), (10, 4 * 3600 * us, "a", None), (11, 30 * 3600 * us, "a", 8.0)]
    rows += [(12, None, "a", 7.0), (13, 9 * 3600 * us, None, 1.5), (14, 9 * 3600 * us, None, 2.5), (15, 12 * 3600 * us, None, 3.5), (16, 7 * 3600 * us, "b", 4.5), (17, None, "c", 1.0)]
    d = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame(rows, "event_id long, us long, event_type string, value double")
    df = df.select("event_id", F.expr("CAST(timestamp_micros(us + 1704067200000000) AS TIMESTAMP_NTZ)").alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", "value", F.lit("{}").alias("props"))
    df.orderBy("event_id").coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


def equals_sql(spark, folder, name):
    got = [tuple(r) for r in QUERIES[name](spark, str(folder)).collect()]
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
        want = c.sql(oracles()[name]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("name", ["shape_tick_candles", "shape_resample"])
def test_candles_of_ties_and_missing_values(spark, odd_events, name):
    equals_sql(spark, odd_events, name)


def test_ties_left_by_the_order(spark):
    ticks = spark.createDataFrame([("a", 0, 0, 2, 1.0), ("a", 0, 0, 1, 2.0), ("a", 0, 1, 3, 5.0), ("a", 9, 4, 7, 3.0), ("a", 9, 5, 9, 4.0), ("a", 9, 5, 8, 6.0)], "sym string, ts long, us long, id long, price double")
    make = lambda **k: shape.ticks_to_candles(ticks.withColumn("volume", F.lit(1.0)), 10, key="sym", **k).select("open", "close").first()
    assert tuple(make(order=["us"], first=["id"])) == (2.0, 6.0)
    assert tuple(make(order=["us", "id"])) == (2.0, 4.0)


def test_ties_take_the_row_read_first(spark, tmp_path):
    """Ids that fall, repeat or lack do not decide between ticks at one time; the place in the table does, file after file."""
    rows = [(9, 5, 1.0), (3, 5, 2.0), (3, 7, 6.0), (None, 9, 3.0), (1, 9, 4.0), (0, 9, 8.0)]
    make = lambda r: spark.createDataFrame(r, "event_id long, us long, value double").coalesce(1).select("event_id", F.expr("CAST(timestamp_micros(us + 1704067200000000) AS TIMESTAMP_NTZ)").alias("ts"), F.lit("a").alias("event_type"), "value")
    make(rows).write.parquet(f"{tmp_path}/one/events.parquet")
    for name in ("shape_tick_candles", "shape_fill_gaps", "shape_quote_join", "shape_resample", "shape_anchored_vwap"):
        equals_sql(spark, tmp_path / "one", name)
    folder = tmp_path / "two" / "events.parquet"
    folder.mkdir(parents=True)
    for k, part in enumerate(([(8, 5, 11.0), (7, 9, 13.0)], rows)):
        make(part).toPandas().astype({"event_id": "Int64"}).to_parquet(folder / f"part-{k}.parquet", coerce_timestamps="us")
    assert [tuple(r)[2:] for r in QUERIES["shape_tick_candles"](spark, str(tmp_path / "two")).collect()] == [(11.0, 13.0, 1.0, 13.0, 8.0)]


def test_gaps_after_ties_and_missing_values(spark, odd_events):
    got = {r[:2]: r[2:] for r in equals_sql(spark, odd_events, "shape_fill_gaps")}
    first = 1_704_067_200_000
    assert got["a", first] == (1.0, 9.0, 1.0, 3.0, 6.0) and got["a", first + 3_600_000] == (6.0, 6.0, 5.0, 5.0, 4.0)
    assert got["a", first + 2 * 3_600_000] == (5.0, 5.0, 5.0, 5.0, 0.0) and ("a", None) not in got


def test_quote_join(spark):
    trades = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "sym string, ts long")
    quotes = spark.createDataFrame([("a", 5, 1.5), ("a", 9, 2.5), ("b", 2, 9.0)], "sym string, ts long, mid double")
    assert sorted((r.sym, r.ts, r.mid) for r in shape.quote_join(trades, quotes, key="sym").collect()) == [("a", 5, 1.5), ("a", 10, 2.5), ("b", 1, None)]


def test_quote_join_of_missing_values(spark, odd_events):
    equals_sql(spark, odd_events, "shape_quote_join")
    trades = spark.createDataFrame([("a", 5), ("a", 10), ("a", 20), ("a", None), (None, 9)], "sym string, ts long")
    quotes = spark.createDataFrame([("a", None, 7.0), ("a", 6, 1.5), ("a", 11, None), (None, 8, 2.5)], "sym string, ts long, mid double")
    got = {(r.sym, r.ts): r.mid for r in shape.quote_join(trades, quotes, key="sym").collect()}
    assert got == {("a", 5): None, ("a", 10): 1.5, ("a", 20): None, ("a", None): None, (None, 9): None}


def test_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("﻿close,extra,timestamp,open, high,low,volume\n 2 ,z,1,1,3,0.5,7\n", encoding="utf-8")
    assert [tuple(r) for r in shape.read_candles(spark, str(good)).collect()] == [(1, 1.0, 3.0, 0.5, 2.0, 7.0)]
    lacking = tmp_path / "lacking.csv"
    lacking.write_text("timestamp,open,high,low,close\n1,1,1,1,1\n")
    with pytest.raises(ValueError):
        shape.read_candles(spark, str(lacking))
    bad = tmp_path / "bad.csv"
    bad.write_text("timestamp,open,high,low,close,volume\n1,1,0.5,1,1,1\n")
    with pytest.raises(Exception, match="invalid candle"):
        shape.read_candles(spark, str(bad)).collect()
    word = tmp_path / "word.csv"
    word.write_text("timestamp,open,high,low,close,volume\n1,x,1,1,1,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        shape.read_candles(spark, str(word)).collect()


def test_streams_equal_batch(spark, tmp_path):
    d = candles(40).assign(sym="a", seq=range(40))
    src = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame(d.iloc[i * 10 : i * 10 + 10]).coalesce(1).write.mode("append").parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = stream_operator(stream, "Rsi", key="sym", order=["ts"], inputs={"x": "close"}, out="o", period=5)
    q = out.writeStream.format("memory").queryName("rsi_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("rsi_out").toPandas().sort_values("ts")["o"].astype(float)
    want = evaluate(flat(OPERATORS["Rsi"].outputs(period=5)), {"x": d.close.to_numpy()}, 40)[0]
    assert np.allclose(got, want, rtol=1e-9, equal_nan=True)


def test_stream_candles(spark, tmp_path):
    src = tmp_path / "ticks"
    rows = [("a", f"2024-01-01 00:0{m}:{s}", float(m * 10 + s), 1.0, m * 60 + s) for m in range(4) for s in (10, 50)]
    df = spark.createDataFrame(rows, "sym string, t string, price double, volume double, seq long").select("sym", F.to_timestamp("t").alias("ts"), "price", "volume", "seq")
    df.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = stream_candles(stream, "1 minute", key="sym", seq="seq").writeStream.format("memory").queryName("candle_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("candle_out").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(m * 10 + 10.0, m * 10 + 50.0, m * 10 + 10.0, m * 10 + 50.0, 2.0) for m in range(3)]
