"""Market-signal analytics as Spark DataFrame transformations."""
