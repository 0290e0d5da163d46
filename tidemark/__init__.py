"""Keyed event logs and tumbling-window aggregates as Spark DataFrame transformations."""

__version__ = "0.1.0"
