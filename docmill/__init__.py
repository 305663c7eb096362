"""Document-quality and usage analytics on PySpark."""
