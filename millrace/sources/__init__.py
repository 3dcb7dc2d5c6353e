"""Sources of the archive engine."""
