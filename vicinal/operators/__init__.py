"""Joins, top-k, partition algebra, reports and checks."""
