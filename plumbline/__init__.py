"""Portfolio risk analytics as Spark DataFrame operators."""
