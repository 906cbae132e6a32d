"""Tidepool: a PySpark-native analytics engine for multi-platform reviews."""
