"""File-arrival jobs."""
