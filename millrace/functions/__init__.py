"""Functions of the archive engine."""
