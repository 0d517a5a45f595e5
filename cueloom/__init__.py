"""Analytics over timed-token tables and training-data corpora, expressed as Spark DataFrame operations."""
