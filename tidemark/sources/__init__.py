"""Sources and the shaping of raw ticks into candles."""
