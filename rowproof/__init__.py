"""Find queries that run cleanly and return wrong rows, and show the rows: Spark jobs only."""
