"""Feed intelligence as Spark DataFrame operators."""
