"""corpusmill: Spark-native document-corpus analytics and hybrid retrieval."""
