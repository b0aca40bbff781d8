"""Zone-by-hour demand analytics as Spark jobs."""
