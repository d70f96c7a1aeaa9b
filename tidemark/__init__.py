"""tidemark: kymograph and track analytics as Spark DataFrame jobs."""
