"""Tidewave: Spark-native analytics over multichannel time series and labelled events."""
