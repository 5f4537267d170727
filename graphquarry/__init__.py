"""Code-knowledge graph queries on Spark."""
