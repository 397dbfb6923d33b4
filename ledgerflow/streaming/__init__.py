"""Stateful streams over the log."""
