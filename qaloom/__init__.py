"""Question/answer dataset curation and retrieval as Spark jobs."""
