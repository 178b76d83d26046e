"""Input series that the tests share."""

import numpy as np
import pandas as pd


def candles(n=90, scale=1.0):
    t = np.arange(n, dtype=float)
    c = 100 + 10 * np.sin(0.3 * t) + 0.5 * t + 3 * np.cos(1.7 * t)
    o = c - np.cos(0.5 * t)
    s = 1 + 0.5 * abs(np.sin(0.7 * t))
    return pd.DataFrame({"ts": t * 3_600_000, "open": o, "high": np.maximum(c, o) + s, "low": np.minimum(c, o) - s, "close": c, "volume": 1000 + 100 * abs(np.sin(0.2 * t))}) * [1, scale, scale, scale, scale, 1]


def columns(n=90, scale=1.0):
    """Every operator input as an array."""
    d = candles(n, scale)
    c, o, h, l, v = (d[k].to_numpy() for k in ("close", "open", "high", "low", "volume"))  # noqa: E741
    t = np.arange(n)
    out = {k: d[k].to_numpy() for k in d.columns} | {"x": c, "y": o}
    out |= {"funding_rate": (c - o) / c, "mark_price": c, "index_price": c - 0.5, "futures_price": c + 1, "open_interest": 10 * v, "long_size": 0.6 * v, "short_size": 0.4 * v}
    out |= {"taker_buy_volume": 0.55 * v, "taker_sell_volume": 0.45 * v, "long_liquidation": h - c, "short_liquidation": c - l}
    out |= {"price": c, "size": v, "side": np.where(c >= o, 1.0, -1.0), "mid": (h + l) / 2}
    out |= {"adv": np.floor(5 + 4 * np.sin(t)), "dec": np.floor(5 - 4 * np.sin(t)), "adv_volume": 2 * v, "dec_volume": 1.5 * v, "members": 10.0 + 0 * t}
    return out | {"highs": np.floor(3 + 2 * np.cos(t)), "lows": np.floor(2 + 2 * np.sin(t)), "above": 4.0 + 0 * t, "signals": 3.0 + 0 * t}
