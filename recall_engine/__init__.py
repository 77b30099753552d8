"""recall_engine: indexing, retrieval and corpus analytics as Spark DataFrame jobs."""
