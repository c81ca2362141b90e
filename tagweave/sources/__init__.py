"""Readers, sinks and table-derived inputs."""
