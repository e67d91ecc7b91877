"""Wardline: analytics of territorial incident data as Spark plans."""

__version__ = "0.1.0"
