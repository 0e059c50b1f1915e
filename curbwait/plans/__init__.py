"""Whole jobs, from trips and zones to a result."""
