"""Registered queries: each Spark job beside an independent SQL statement of the same result."""
