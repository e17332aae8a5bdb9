"""Spark-native analysis of native-rate time series: baselines, events, ratios and their uncertainty."""

__version__ = "0.1.0"
