"""Research on (date, asset) panels as Spark jobs."""
