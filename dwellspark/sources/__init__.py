"""Activity sources."""
