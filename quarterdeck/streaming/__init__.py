"""Intentionally empty: the workload is quarterly batch data.

Late data exists only as data semantics (amendments and availability cut-offs),
handled in ``operators.filings`` and ``operators.peers``.
"""
