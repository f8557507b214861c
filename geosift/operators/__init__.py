"""Relational operators as DataFrame-to-DataFrame functions."""
