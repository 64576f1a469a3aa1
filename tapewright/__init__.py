"""Intraday bar research on Spark: bars, levels, zones, signals, trades and their statistics as DataFrame operators."""
