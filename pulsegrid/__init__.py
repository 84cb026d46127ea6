"""Spark-first analytics for pulse signals, keyed time series and text corpora."""
