"""Operators on segmented sequences."""
