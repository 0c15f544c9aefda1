"""Document-retrieval analytics on Spark: corpora, hybrid search, cited answers, evaluation and lifecycles."""
