"""Toll-passage analytics and hourly traffic forecasting as Spark DataFrame functions."""
