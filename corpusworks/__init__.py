"""Building, validating and auditing instruction and code corpora with PySpark."""
