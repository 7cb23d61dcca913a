"""A tabular analytics engine expressed as Spark DataFrame transformations."""
