"""Readers: pairs files, Parquet matrices and synthetic pairs."""
