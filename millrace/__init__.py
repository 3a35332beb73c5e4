"""Millrace: retrieval, matching and conversation analytics expressed as Spark DataFrame plans."""
