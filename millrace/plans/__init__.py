"""Plans of the archive engine."""
