"""Driver queries of the market operators, each over all rows of its tables, and their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import books
from .operators import OPERATORS
from .operators.bars import BARS
from .operators.catalog import INPUTS
from .plans import handwritten
from .plans.emit import build_bars
from .plans.spark import apply, flat, is_native, named
from .plans.sql import query
from .sources import candles as shape

#: Candles of four hours, in milliseconds.
SIZE = 4 * 3_600_000
DIGITS = 6

CANDLES_SQL = f"""SELECT sym, ts, arg_min(value, ms) AS open, max(value) AS high, min(value) AS low, arg_max(value, ms) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM (SELECT event_type AS sym, value, epoch_us(ts) AS ms, epoch_ms(ts) - epoch_ms(ts) % {SIZE} AS ts FROM events) e GROUP BY sym, ts"""

#: Inputs of each kind as expressions over a candle, valid in both dialects.
EXPRESSIONS = {
    "x": {"x": "close"},
    "pair": {"x": "close", "y": "open"},
    "derivatives": {
        "funding_rate": "(close - open) / (close + 1) * 0.01", "mark_price": "close + 1", "index_price": "close + 1.5", "futures_price": "close + 2", "open_interest": "10 * volume", "long_size": "0.6 * volume",
        "short_size": "0.4 * volume", "taker_buy_volume": "0.55 * volume", "taker_sell_volume": "0.45 * volume", "long_liquidation": "high - close", "short_liquidation": "close - low",
    },
    "trade": {"price": "close + 1", "size": "volume", "side": "CASE WHEN close >= open THEN 1.0 ELSE -1.0 END"},
    "quote": {"price": "close + 1", "size": "volume", "side": "CASE WHEN close >= open THEN 1.0 ELSE -1.0 END", "mid": "(high + low) / 2 + 1"},
}

BREADTH_SQL = f"""SELECT 'all' AS sym, ts, CAST(sum(CASE WHEN close > open THEN 1 ELSE 0 END) AS DOUBLE) AS adv, CAST(sum(CASE WHEN close < open THEN 1 ELSE 0 END) AS DOUBLE) AS "dec",
 sum(CASE WHEN close > open THEN volume ELSE 0.0 END) AS adv_volume, sum(CASE WHEN close < open THEN volume ELSE 0.0 END) AS dec_volume, sum(volume) AS volume, CAST(count(*) AS DOUBLE) AS members,
 CAST(sum(CASE WHEN close = high THEN 1 ELSE 0 END) AS DOUBLE) AS highs, CAST(sum(CASE WHEN close = low THEN 1 ELSE 0 END) AS DOUBLE) AS lows,
 CAST(sum(CASE WHEN close > (high + low) / 2 THEN 1 ELSE 0 END) AS DOUBLE) AS above, CAST(sum(CASE WHEN volume > 10 THEN 1 ELSE 0 END) AS DOUBLE) AS signals
FROM ({CANDLES_SQL}) c GROUP BY ts"""


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def output(name: str) -> str:
    """Output column of an operator's query, other than its inputs."""
    return snake(name) + ("_value" if snake(name) in INPUTS[OPERATORS[name].kind] else "")


def candles(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = shape.epoch_micros(events, "ts")
    ticks = events.select(F.col("event_type").alias("sym"), F.floor(us / 1000).alias("ts"), us.alias("us"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    # the SQL's arg_min and arg_max keep the first row they read of those at one time, whatever its id
    return shape.ticks_to_candles(ticks, size, key="sym", order=["us"], first=["file", "row"])


def _source(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    d = candles(spark, sf_dir)
    if kind == "breadth":
        d = d.select("ts", (F.col("close") - F.col("open")).alias("change"), "volume", (F.col("close") == F.col("high")).alias("new_high"), (F.col("close") == F.col("low")).alias("new_low"), (F.col("close") > (F.col("high") + F.col("low")) / 2).alias("above_ma"), (F.col("volume") > 10).alias("on_buy_signal"))
        return shape.breadth(d).withColumn("sym", F.lit("all"))
    if kind in EXPRESSIONS:
        return d.select("sym", "ts", *[F.expr(e).cast("double").alias(k) for k, e in EXPRESSIONS[kind].items()])
    return d


def _source_sql(kind: str) -> str:
    if kind == "breadth":
        return BREADTH_SQL
    if kind in EXPRESSIONS:
        return f"SELECT sym, ts, {', '.join(f'{e} AS {k}' for k, e in EXPRESSIONS[kind].items())} FROM ({CANDLES_SQL}) c"
    return CANDLES_SQL


def _rounded(df: DataFrame, outs: dict) -> DataFrame:
    cols = []
    for k, v in outs.items():
        c = F.transform(k, lambda x: F.round(x, DIGITS) + F.lit(0.0)) if isinstance(v, list) else F.round(k, DIGITS) + F.lit(0.0)
        cols.append(c.alias(k))
    return df.select("sym", "ts", *cols)


def _operator(name: str):
    op = OPERATORS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        outs = named(op.outputs(), output(name))
        return _rounded(apply(_source(spark, sf_dir, op.kind), name, key="sym", order=["ts"], out=output(name)), outs)

    return run


def _bars(name: str):
    sizes = {"RenkoBars": {"box_size": 20.0}, "KagiBars": {"reversal": 20.0}, "PointAndFigureBars": {"box_size": 20.0}, "RangeBars": {"range_": 20.0}, "VolumeBars": {"volume_per_bar": 50.0}, "DollarBars": {"dollar_per_bar": 2000.0}, "Footprint": {"tick_size": 50.0}}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind = "trade" if name == "Footprint" else "candle"
        return build_bars(_source(spark, sf_dir, kind), name, key="sym", order=["ts"], **sizes.get(name, {}))

    return run


BOOK = "transform(sequence(1, 5), k -> named_struct('price', {0} CAST(k AS DOUBLE) * 0.1, 'size', volume / k * {1}))"


def _with_books(d: DataFrame) -> DataFrame:
    return d.withColumn("bids", F.expr(BOOK.format("close + 1 -", "1.0D"))).withColumn("asks", F.expr(BOOK.format("close + 1 +", "0.9D")))


def _book(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _with_books(candles(spark, sf_dir))
        return d.select("sym", "ts", F.round(books.BOOKS[name](F.col("bids"), F.col("asks")), DIGITS).alias(snake(name)))

    return run


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = books.order_flow_imbalance(_with_books(candles(spark, sf_dir)), "sym", ["ts"], 20, out="order_flow_imbalance")
    return d.select("sym", "ts", F.round("order_flow_imbalance", DIGITS).alias("order_flow_imbalance"))


# ---- data layer


def shape_ticks(spark, sf_dir): return candles(spark, sf_dir, 3_600_000)
def shape_resample(spark, sf_dir): return shape.resample(candles(spark, sf_dir, 3_600_000), 86_400_000, key="sym")
def shape_fill(spark, sf_dir): return shape.fill_gaps(candles(spark, sf_dir, 3_600_000), 3_600_000, key="sym")


def shape_quotes(spark, sf_dir):
    c = candles(spark, sf_dir, 3_600_000)
    quotes = candles(spark, sf_dir, 4 * 3_600_000).select("sym", "ts", ((F.col("high") + F.col("low")) / 2).alias("mid"))
    out = shape.quote_join(c.select("sym", "ts", "close"), quotes, key="sym")
    return out.select("sym", "ts", "close", F.round("mid", DIGITS).alias("mid"))


def shape_anchored(spark, sf_dir):
    d = shape.anchored(candles(spark, sf_dir).withColumn("day_start", F.col("ts") % 86_400_000 == 0), "day_start", key="sym", order=["ts"])
    d = apply(d, "Vwap", key=["sym", "segment"], order=["ts"], out="vwap")
    return d.select("sym", "ts", "segment", F.round("vwap", DIGITS).alias("vwap"))


def shape_chain(spark, sf_dir):
    """RSI(14) of the close, fed to SMA(5): the average counts the RSI's values only."""
    d = apply(candles(spark, sf_dir), "Rsi", key="sym", order=["ts"], inputs={"x": "close"}, out="rsi")
    d = apply(d, "Sma", key="sym", order=["ts"], inputs={"x": "rsi"}, out="rsi_sma", period=5)
    return d.select("sym", "ts", F.round("rsi_sma", DIGITS).alias("rsi_sma"))


HOURLY_SQL = CANDLES_SQL.replace(str(SIZE), "3600000")
SHAPE_SQL = {
    "shape_tick_candles": f"SELECT sym, ts, open, high, low, close, volume FROM ({HOURLY_SQL}) c",
    "shape_resample": CANDLES_SQL.replace(str(SIZE), "86400000"),
    "shape_fill_gaps": f"""WITH c AS ({HOURLY_SQL}), n AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY sym ORDER BY ts), ts + 3600000) AS nx FROM c),
f AS (SELECT n.*, unnest(range(ts, nx, 3600000)) AS t FROM n)
SELECT sym, t AS ts, CASE WHEN t = ts THEN open ELSE close END AS open, CASE WHEN t = ts THEN high ELSE close END AS high, CASE WHEN t = ts THEN low ELSE close END AS low, close, CASE WHEN t = ts THEN volume ELSE 0.0 END AS volume FROM f""",
    "shape_quote_join": f"""SELECT t.sym, t.ts, t.close, round((q.high + q.low) / 2, {DIGITS}) AS mid FROM ({HOURLY_SQL}) t ASOF LEFT JOIN ({CANDLES_SQL}) q ON t.sym = q.sym AND t.ts >= q.ts""",
    "shape_anchored_vwap": f"""WITH c AS (SELECT *, sum(CASE WHEN ts % 86400000 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS segment FROM ({CANDLES_SQL}) c)
SELECT sym, ts, CAST(segment AS BIGINT) AS segment, round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, {DIGITS}) AS vwap FROM c WINDOW w AS (PARTITION BY sym, segment ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
}

_BID, _ASK = "[{'p': close + 1 - k * 0.1, 'q': volume / k} for k in [1, 2, 3, 4, 5]]", "[{'p': close + 1 + k * 0.1, 'q': volume / k * 0.9} for k in [1, 2, 3, 4, 5]]"


def _book_sql(name: str) -> str:
    s = lambda side, n: f"list_sum([x.q for x in {side}[1:{n}]])"
    imb = lambda n: f"({s('b', n)} - {s('a', n)}) / ({s('b', n)} + {s('a', n)})"
    e = {
        "OrderBookImbalanceTop1": imb(1), "OrderBookImbalanceTopN": imb(5), "OrderBookImbalanceFull": imb(5),
        "DepthSlope": f"({_side_sql('b')} + {_side_sql('a')}) / 2", "Microprice": "(b[1].p * a[1].q + a[1].p * b[1].q) / (a[1].q + b[1].q)", "QuotedSpread": "(a[1].p - b[1].p) / ((a[1].p + b[1].p) / 2) * 10000",
    }[name]
    return f"SELECT sym, ts, round({e}, {DIGITS}) AS {snake(name)} FROM (SELECT sym, ts, {_BID} AS b, {_ASK} AS a FROM ({CANDLES_SQL}) c) d"


def _side_sql(side: str) -> str:
    """Least-squares slope of the size so far on the distance from the mid, over five levels."""
    return f"(SELECT regr_slope(q, d) FROM (SELECT abs({side}[k].p - (b[1].p + a[1].p) / 2) AS d, list_sum([x.q for x in {side}[1:k]]) AS q FROM range(1, 6) r(k)) s)"


ORDER_FLOW_SQL = f"""WITH d AS (SELECT sym, ts, close + 1 - 0.1 AS bp, volume AS bq, close + 1 + 0.1 AS ap, volume * 0.9 AS aq FROM ({CANDLES_SQL}) c),
e AS (SELECT *, CASE WHEN bp >= lag(bp) OVER o THEN bq ELSE 0 END - CASE WHEN bp <= lag(bp) OVER o THEN lag(bq) OVER o ELSE 0 END - CASE WHEN ap <= lag(ap) OVER o THEN aq ELSE 0 END + CASE WHEN ap >= lag(ap) OVER o THEN lag(aq) OVER o ELSE 0 END AS e,
 row_number() OVER o AS i FROM d WINDOW o AS (PARTITION BY sym ORDER BY ts))
SELECT sym, ts, CASE WHEN i > 20 THEN round(sum(e) OVER (PARTITION BY sym ORDER BY ts ROWS 19 PRECEDING), {DIGITS}) END AS order_flow_imbalance FROM e"""


TICK_BARS_SQL = f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts) - 1 AS rn FROM ({CANDLES_SQL}) c)
SELECT sym, max(ts) AS ts, CAST(0 AS INTEGER) AS bar, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
FROM c GROUP BY sym, rn // 10 HAVING count(*) = 10"""

QUERIES = {
    "shape_tick_candles": shape_ticks, "shape_resample": shape_resample, "shape_fill_gaps": shape_fill, "shape_quote_join": shape_quotes, "shape_anchored_vwap": shape_anchored, "shape_chain": shape_chain,
    **{f"ind_{snake(n)}": _operator(n) for n in OPERATORS}, **{f"ind_{snake(n)}": _book(n) for n in books.BOOKS}, "ind_order_flow_imbalance": order_flow, **{f"bars_{snake(n)}": _bars(n) for n in BARS},
}


def oracles() -> dict[str, str]:
    out = dict(SHAPE_SQL)
    for n, op in OPERATORS.items():
        if is_native(flat(op.outputs())):
            out[f"ind_{snake(n)}"] = query(_source_sql(op.kind), n, "sym", "ts", out=output(n), digits=DIGITS)
    for n, sql in handwritten.SQL.items():
        out[f"ind_{snake(n)}"] = sql(_source_sql(OPERATORS[n].kind), output(n), DIGITS)
    out["shape_chain"] = handwritten.CHAIN(_source_sql("x"), "rsi_sma", DIGITS)
    out |= {f"ind_{snake(n)}": _book_sql(n) for n in books.BOOKS}
    out |= {f"bars_{snake(n)}": sql(_source_sql("trade" if n == "Footprint" else "candle")) for n, sql in handwritten.BARS.items()}
    return out | {"ind_order_flow_imbalance": ORDER_FLOW_SQL, "bars_tick_bars": TICK_BARS_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of every event type with a few indicators, in one exchange by symbol."""
    d = candles(spark, sf_dir, 86_400_000)
    for name, inputs, params in (("Sma", {"x": "close"}, {"period": 5}), ("BollingerBands", {"x": "close"}, {"period": 5, "multiplier": 2.0}), ("Roc", {"x": "close"}, {"period": 3}), ("Obv", {}, {})):
        d = apply(d, name, key="sym", order=["ts"], inputs=inputs, **params)
    return d
