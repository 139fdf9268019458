"""Batch and streaming jobs that turn public posts into measured signals, as plain PySpark DataFrame functions."""
