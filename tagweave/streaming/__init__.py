"""Structured Streaming entry points for caption folders that keep
receiving files."""
