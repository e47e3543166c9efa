"""Automated data analysis on Spark: profile, health, patterns, tests, features, models."""

__version__ = "0.1.0"
