"""Sonolith: recordings and other time series on Spark, from metadata to evaluated models."""
