"""Point-in-time signal analytics as Spark DataFrame jobs."""
