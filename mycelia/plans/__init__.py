"""Whole computations made of operators."""
