"""Composed jobs, the stand-in views over the driver tables, and the query catalogue."""
