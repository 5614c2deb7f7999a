"""Scalar functions and parsing."""
