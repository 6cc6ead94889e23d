"""Scalar, aggregate, window and calendar functions as Column expressions."""
