"""Text and source-code analytics as Spark DataFrame plans."""
