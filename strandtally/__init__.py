"""Fragment assignment and quantification as Spark jobs."""
