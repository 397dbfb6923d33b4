"""Readers of log and snapshot files."""
