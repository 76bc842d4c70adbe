"""Forecasting tables on Spark: build, audit, model and score hourly series at scale."""
