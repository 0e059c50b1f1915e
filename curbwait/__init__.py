"""Idle time between taxi fares by region, as PySpark DataFrame jobs."""
