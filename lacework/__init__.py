"""Graph pattern mining on PySpark."""
