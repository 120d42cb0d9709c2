"""A retrieval engine over document archives, as Spark DataFrame transformations."""
