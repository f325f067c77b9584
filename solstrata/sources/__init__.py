"""Readers: files, tables and saved JSON as DataFrames."""
