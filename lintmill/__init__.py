"""Corpus migration analytics as PySpark jobs.

Sources produce files, lines, cells and findings; operators join, score,
rewrite, validate and report on them; plans chain operators into whole runs.
"""
