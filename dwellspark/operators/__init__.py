"""Activity operators."""
