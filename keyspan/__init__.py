"""Sparse learning analytics as lazy DataFrame transformations."""
