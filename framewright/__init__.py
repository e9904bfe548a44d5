"""Segmented-sequence analytics as plain DataFrame operations."""
