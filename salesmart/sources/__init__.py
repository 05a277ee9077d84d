"""Readers: CSV files, catalog tables, JDBC tables."""
