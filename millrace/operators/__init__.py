"""Operators of the archive engine."""
