"""Ticks and candles: CSV source, validation, tick-to-candle roll-up, resampling, gap filling, quote join, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDLE = T.StructType([T.StructField("ts", T.LongType()), *[T.StructField(k, T.DoubleType()) for k in ("open", "high", "low", "close", "volume")]])
CSV_COLUMNS = ("timestamp", "open", "high", "low", "close", "volume")
#: Most candles that one gap may be filled with.
MOST_FILLED = 1_000_000


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch; a timestamp without time zone counts as UTC, whatever the session's zone."""
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(name)
    d = f"(`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return F.expr(f"extract(DAY FROM {d}) * 86400000000L + extract(HOUR FROM {d}) * 3600000000L + extract(MINUTE FROM {d}) * 60000000L + CAST(extract(SECOND FROM {d}) * 1000000 AS BIGINT)")


def valid_candle() -> Column:
    """All finite; volume not negative; high at least, low at most, the other prices."""
    ok = F.col("high") >= F.greatest("open", "close", "low")
    ok = ok & (F.col("low") <= F.least("open", "close", "high")) & (F.col("volume") >= 0)
    for k in ("open", "high", "low", "close", "volume"):
        ok = ok & F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(F.col(k)) != float("inf"))
    return ok & F.col("ts").isNotNull()


def read_candles(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """ts (long) and OHLCV of CSV files whose header has the six names, in any order and among others.

    Values are trimmed and a UTF-8 byte order mark is dropped; a value that is no number, or an invalid
    candle where ``validate`` is set, fails the query. Files that are read together must have the same header: one
    with other names, or in another order, fails the query."""
    raw = spark.read.option("header", True).option("enforceSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = {c.removeprefix("﻿").strip(): c for c in raw.columns}
    if missing := [c for c in CSV_COLUMNS if c not in names]:
        raise ValueError(f"CSV header lacks {missing}")
    number = lambda c, kind: F.col(f"`{names[c]}`").cast(kind)
    df = raw.select(number("timestamp", "bigint").alias("ts"), *[number(c, "double").alias(c) for c in CSV_COLUMNS[1:]])
    if validate:
        df = df.select(F.when(valid_candle(), F.col("ts")).otherwise(F.raise_error(F.lit("invalid candle")).cast("bigint")).alias("ts"), *CSV_COLUMNS[1:])
    return df


def bucket(ts: Column, size: int) -> Column:
    """Start of the bucket that holds ts, for negative times as well."""
    return ts - F.pmod(ts, F.lit(size))


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _at(value: str, ts: str, *order: Column | str) -> Column:
    """What orders a value; null, so that min_by and max_by pass over the row, where the value or its time is."""
    return F.when(F.col(value).isNotNull() & F.col(ts).isNotNull(), F.struct(*order))


def ticks_to_candles(ticks: DataFrame, size: int, *, key: str | list[str], ts: str = "ts", price: str = "price", volume: str = "volume", order: list[str] | None = None, first: list[str] | None = None) -> DataFrame:
    """Candles of ``size`` time units, stamped with the bucket's start; ``order`` breaks ties of ts. One aggregation, combined before the shuffle.

    Ticks without a price count for the volume only. ``first``: of the ticks that ``order`` leaves tied the one with the lowest
    values of these columns opens, and closes, the candle; ts and ``order`` must be integers then."""
    at = [ts, *(order or [])]
    close = F.min_by(price, _at(price, ts, *[F.bitwise_not(c) for c in at], *first)) if first else F.max_by(price, _at(price, ts, *at))
    b = bucket(F.col(ts).cast("long"), size).alias("ts")
    return ticks.groupBy(*_keys(key), b).agg(
        F.min_by(price, _at(price, ts, *at, *(first or []))).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), close.alias("close"), F.sum(volume).alias("volume")
    )


def resample(candles: DataFrame, size: int, *, key: str | list[str], ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """Coarser candles; the last, still open one is included."""
    b = bucket(F.col(ts).cast("long"), size).alias("_b")
    out = candles.groupBy(*_keys(key), b).agg(
        F.min_by("open", _at("open", ts, ts, *(order or []))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", _at("close", ts, ts, *(order or []))).alias("close"), F.sum("volume").alias("volume")
    )
    return out.withColumnRenamed("_b", "ts")


def fill_gaps(candles: DataFrame, size: int, *, key: str | list[str], ts: str = "ts") -> DataFrame:
    """A flat candle at the previous close, volume 0, for each bucket skipped; more than a million in one gap fail the query. Candles without a time are left out."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(ts)
    following = F.coalesce(F.lead(ts).over(w), F.col(ts) + size)
    n = (following - F.col(ts)) / size
    d = candles.withColumn("_next", F.when(n > MOST_FILLED + 1, F.raise_error(F.lit("gap too long")).cast("bigint")).otherwise(following))
    d = d.withColumn("_at", F.explode(F.sequence(F.col(ts), F.col("_next") - F.lit(1), F.lit(size))))
    real = F.col("_at") == F.col(ts)
    flat = {k: F.when(real, F.col(k)).otherwise(F.col("close")) for k in ("open", "high", "low")}
    return d.select(*keys, F.col("_at").alias(ts), *[c.alias(k) for k, c in flat.items()], "close", F.when(real, F.col("volume")).otherwise(0.0).alias("volume"))


def in_order(df: DataFrame, *, key: str | list[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Fails the query where time goes back in arrival order (``seq``) within a key."""
    p = F.lag(ts).over(Window.partitionBy(*_keys(key)).orderBy(seq))
    checked = F.when(p.isNull() | (F.col(ts) >= p), F.col(ts)).otherwise(F.raise_error(F.lit("time goes back")).cast(df.schema[ts].dataType))
    return df.withColumn(ts, checked)


def quote_join(trades: DataFrame, quotes: DataFrame, *, key: str | list[str], ts: str = "ts", mid: str = "mid") -> DataFrame:
    """Trades with the mid of the last quote at or before each (as-of join): one union, one sort, no pair is formed.

    The mid is null where that quote has none. A null key or time matches nothing."""
    keys = _keys(key)
    names = trades.columns
    q = quotes.where(F.col(ts).isNotNull()).select(*keys, F.col(ts), F.struct(F.col(mid).cast("double").alias("mid")).alias("_m")).withColumn("_trade", F.lit(0))
    t = trades.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast(q.schema["_m"].dataType).alias("_m"), F.lit(1).alias("_trade"))
    both = t.unionByName(q, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "_trade").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(ts).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return both.withColumn(mid, F.when(known, F.last("_m", ignorenulls=True).over(w)["mid"])).where("_trade = 1").select(*[F.col(f"`{c}`") for c in names], mid)


def anchored(df: DataFrame, flag: str, *, key: str | list[str], order: list[str], out: str = "segment") -> DataFrame:
    """Numbers the stretches that start at rows whose flag is true; add ``out`` to an operator's key to restart it there."""
    w = Window.partitionBy(*_keys(key)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.coalesce(F.col(flag).cast("int"), F.lit(0))).over(w))


def breadth(members: DataFrame, *, ts: str = "ts") -> DataFrame:
    """Per time: advancers, decliners, their volume and the flag counts of a universe in long form
    (change, volume, new_high, new_low, above_ma, on_buy_signal)."""
    up, down = F.col("change") > 0, F.col("change") < 0
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    vol = lambda c: F.sum(F.when(c, F.col("volume")).otherwise(0.0))
    return members.groupBy(ts).agg(
        count(up).alias("adv"), count(down).alias("dec"), vol(up).alias("adv_volume"), vol(down).alias("dec_volume"), F.sum("volume").alias("volume"), F.count(F.lit(1)).cast("double").alias("members"),
        count(F.col("new_high")).alias("highs"), count(F.col("new_low")).alias("lows"), count(F.col("above_ma")).alias("above"), count(F.col("on_buy_signal")).alias("signals"),
    )
