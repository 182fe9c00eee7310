"""Scalar functions whose business-intelligence meaning differs from one Spark built-in.

Where a Spark function already means the same it is used directly; ``FUNCTIONS.md`` at the
repository root lists those.
"""
