"""Operators: cleaning, joins, aggregations, focal and region jobs."""
