"""Activity streaming."""
