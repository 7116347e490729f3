"""Transaction-risk analytics as Spark DataFrame operators."""
