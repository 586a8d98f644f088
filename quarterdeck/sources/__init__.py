"""Readers: every function returns a lazy DataFrame."""
