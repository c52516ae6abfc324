"""Contract and document analytics as Spark DataFrame transforms."""
