"""Derived graphs over the tables, and the registered queries."""
