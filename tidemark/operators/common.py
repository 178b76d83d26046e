"""Input columns and derived series that families share."""

from ..plans.expr import abs, col, div, ema, lag, mx, rma, where  # noqa: A004, F401

x, y = col("x"), col("y")
o, h, l, c, v, ts = (col(k) for k in ("open", "high", "low", "close", "volume", "ts"))  # noqa: E741
typical = (h + l + c) / 3.0
median = (h + l) / 2.0


def true_range():
    """High minus low on the first bar."""
    p = lag(c)
    from ..plans.expr import fn

    return fn("coalesce", mx(h - l, abs(h - p), abs(l - p)), h - l)


def atr(n):
    return rma(true_range(), n)
