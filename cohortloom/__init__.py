"""Cohort building, windowed features and scoring as plain Spark DataFrame functions."""

__version__ = "0.1.0"
