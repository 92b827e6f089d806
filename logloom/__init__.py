"""A security-event analytics library on PySpark."""
