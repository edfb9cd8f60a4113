"""Retail analytics operators on PySpark: DataFrames in, DataFrames out."""
