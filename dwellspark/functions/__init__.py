"""Activity functions."""
