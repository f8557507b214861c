"""Whole plans: search, import, catalogue of queries."""
