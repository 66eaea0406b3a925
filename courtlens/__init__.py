"""Rally-sport analytics as Spark DataFrame plans."""
