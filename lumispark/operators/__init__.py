"""Relational operators over measurement, track and pixel tables."""
