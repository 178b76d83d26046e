"""Order-book functions over array<struct<price, size>> columns, the best level first; no Python at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(levels: Column, n: int | None = None) -> Column:
    side = levels if n is None else F.slice(levels, 1, n)
    return F.aggregate(side, F.lit(0.0), lambda a, x: a + x["size"])


def imbalance(b: Column, a: Column) -> Column:
    return F.when(a + b > 0, (b - a) / (a + b)).otherwise(0.0)


def order_book_imbalance_top1(bids: Column, asks: Column) -> Column:
    return imbalance(bids[0]["size"], asks[0]["size"])


def order_book_imbalance_topn(bids: Column, asks: Column, levels: int = 5) -> Column:
    return imbalance(total(bids, levels), total(asks, levels))


def order_book_imbalance_full(bids: Column, asks: Column) -> Column:
    return imbalance(total(bids), total(asks))


def microprice(bids: Column, asks: Column) -> Column:
    """Mid weighted by the opposite sizes; the plain mid without sizes."""
    b, a = bids[0], asks[0]
    s = b["size"] + a["size"]
    return F.when(s > 0, (b["price"] * a["size"] + a["price"] * b["size"]) / s).otherwise((b["price"] + a["price"]) / 2)


def quoted_spread(bids: Column, asks: Column) -> Column:
    """In basis points of the mid."""
    b, a = bids[0]["price"], asks[0]["price"]
    return (a - b) / ((a + b) / 2) * 10_000.0


def _side_slope(levels: Column, mid: Column) -> Column:
    """Least-squares slope of cumulative size on distance from the mid."""
    start = F.struct(F.lit(0.0).alias("q"), *[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy")])

    def add(s: Column, v: Column) -> Column:
        q, d = s["q"] + v["size"], F.abs(v["price"] - mid)
        return F.struct(q.alias("q"), (s["n"] + 1).alias("n"), (s["x"] + d).alias("x"), (s["y"] + q).alias("y"), (s["xx"] + d * d).alias("xx"), (s["xy"] + d * q).alias("xy"))

    def slope(s: Column) -> Column:
        d = s["n"] * s["xx"] - s["x"] * s["x"]
        return F.when(d != 0, (s["n"] * s["xy"] - s["x"] * s["y"]) / d).otherwise(0.0)

    return F.aggregate(levels, start, add, slope)


def depth_slope(bids: Column, asks: Column) -> Column:
    mid = (bids[0]["price"] + asks[0]["price"]) / 2
    return (_side_slope(bids, mid) + _side_slope(asks, mid)) / 2


BOOKS: dict[str, Callable[..., Column]] = {
    "OrderBookImbalanceTop1": order_book_imbalance_top1, "OrderBookImbalanceTopN": order_book_imbalance_topn, "OrderBookImbalanceFull": order_book_imbalance_full,
    "Microprice": microprice, "QuotedSpread": quoted_spread, "DepthSlope": depth_slope,
}


def order_flow_imbalance(df: DataFrame, key: str | list[str], order: list[str], period: int = 20, bids: str = "bids", asks: str = "asks", out: str = "ofi") -> DataFrame:
    """OrderFlowImbalance: sum over ``period`` changes of what the best bid gained less what the best ask gained."""
    keys = [key] if isinstance(key, str) else list(key)
    o = Window.partitionBy(*keys).orderBy(*order)
    best = {"bp": F.col(bids)[0]["price"], "bq": F.col(bids)[0]["size"], "ap": F.col(asks)[0]["price"], "aq": F.col(asks)[0]["size"]}
    d = df.withColumns({f"_{k}": v for k, v in best.items()})
    d = d.withColumns({f"_p{k}": F.lag(f"_{k}").over(o) for k in best})
    c = {k: F.col(f"_{k}") for k in best} | {f"p{k}": F.col(f"_p{k}") for k in best}
    bid = F.when(c["bp"] >= c["pbp"], c["bq"]).otherwise(0.0) - F.when(c["bp"] <= c["pbp"], c["pbq"]).otherwise(0.0)
    ask = F.when(c["ap"] <= c["pap"], c["aq"]).otherwise(0.0) - F.when(c["ap"] >= c["pap"], c["paq"]).otherwise(0.0)
    d = d.withColumn("_e", F.when(c["pbp"].isNotNull(), bid - ask))
    w = o.rowsBetween(1 - period, 0)
    return d.withColumn(out, F.when(F.count("_e").over(w) == period, F.sum("_e").over(w))).select(*[F.col(f"`{k}`") for k in df.columns], out)
