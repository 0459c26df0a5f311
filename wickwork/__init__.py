"""Candlestick (OHLCV) research as Spark table jobs."""
