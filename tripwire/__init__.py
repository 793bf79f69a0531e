"""Telemetry decision engine built on Spark DataFrames."""
