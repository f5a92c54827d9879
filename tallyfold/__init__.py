"""Business documents in, checked structured records out, as Spark DataFrame jobs."""
