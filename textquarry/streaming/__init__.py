"""Watched folders and change streams on Structured Streaming."""
