"""corpusmill: Spark-native text-corpus analytics (see README.md)."""
