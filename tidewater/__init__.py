"""Regime-switching time-series restoration on Spark."""
