"""Procurement and spend auditing as composable Spark DataFrame transforms."""
