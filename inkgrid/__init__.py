"""Image, outline and catalogue analytics as Spark DataFrame operators."""
