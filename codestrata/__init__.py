"""Source-code analytics and corpus operations as Spark DataFrame plans."""
