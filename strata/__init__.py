"""Strata: a closed SQL dialect and versioned parquet tables on PySpark."""

__version__ = "0.1.0"
