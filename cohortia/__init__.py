"""Cohort analytics for linked exam or event populations, as Spark DataFrame operators."""

__version__ = "0.1.0"
