"""Operators on the fact table and on hourly series."""
