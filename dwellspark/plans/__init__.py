"""Activity plans."""
