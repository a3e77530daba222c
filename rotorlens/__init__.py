"""Analytic operators for machine condition data on Spark."""
__version__ = "0.1.0"
