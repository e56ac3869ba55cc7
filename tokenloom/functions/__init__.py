"""Scalar functions and regular expressions."""
