"""Document-review analytics on PySpark."""
