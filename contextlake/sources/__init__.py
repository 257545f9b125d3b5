"""Readers of text tables and derived inputs."""
