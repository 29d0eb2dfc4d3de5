"""barloom: bar-data analytics as PySpark DataFrame operators."""
