"""Registered queries and jobs."""
