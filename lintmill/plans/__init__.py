"""Operators chained into whole runs."""
