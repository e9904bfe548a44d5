"""Operators on unbounded frame streams."""
