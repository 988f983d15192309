"""A Spark-first engine for curating document corpora."""
