"""loomline: document, retrieval and timeline analytics as Spark DataFrame jobs."""
