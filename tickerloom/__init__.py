"""Point-in-time market and news evidence analytics as Spark jobs."""
