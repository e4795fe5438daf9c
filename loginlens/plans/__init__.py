"""End-to-end analyses and their parameters."""
