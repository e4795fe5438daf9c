"""Incremental features and scoring with Structured Streaming."""
