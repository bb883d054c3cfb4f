"""Sensor readings on Spark: profile, correlate, train regressors, fill gaps."""

__version__ = "0.1.0"
