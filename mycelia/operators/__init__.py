"""Operators on edges, vertices and labels."""
