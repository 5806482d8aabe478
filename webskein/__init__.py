"""Web content analytics expressed as Spark DataFrame plans."""
