"""turnwise: conversation analytics as Spark jobs."""
