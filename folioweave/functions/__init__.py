"""Scalar helpers: paths, Python text of values, JSON-Schema checks, templates."""
