"""Skyline explanations of node classifications, as Spark plans."""
