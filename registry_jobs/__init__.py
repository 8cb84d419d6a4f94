"""Spark jobs that turn machine-read land-registry texts into clean tables."""
