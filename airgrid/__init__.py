"""Spark jobs for air-quality and remote-sensing tables."""
