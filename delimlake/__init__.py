"""Messy delimited text to tables, as Spark DataFrames."""
