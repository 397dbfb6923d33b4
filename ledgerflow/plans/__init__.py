"""The query catalogue over the test tables."""
