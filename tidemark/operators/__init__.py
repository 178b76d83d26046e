"""All operators; importing this package fills the catalogue."""

from . import averages, candles, cycle, markets, momentum, patterns, pivots, profiles, risk, seasonality, statistics, stops, trend, volatility, volume  # noqa: F401
from .catalog import OPERATORS, get  # noqa: F401
