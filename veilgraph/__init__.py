"""Sensitive-information analytics expressed as Spark DataFrame plans."""
