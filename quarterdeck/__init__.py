"""Institutional-holdings analytics as PySpark DataFrame functions."""
