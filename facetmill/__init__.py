"""Recurring value patterns of tables, as Spark jobs."""
