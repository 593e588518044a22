"""Spark jobs for monitoring fields through a growing season."""
