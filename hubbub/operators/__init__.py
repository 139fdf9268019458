"""Operators: functions from DataFrames to a DataFrame. Times are half-open intervals, as_of is always an argument."""
