"""Document and publication analytics on PySpark."""
