"""Document-retrieval analytics on Spark: structure, chunks, search, evaluation."""
