"""Evidence-to-profile analytics on PySpark."""
