"""tidemark: Spark-native analytics for binary-outcome market tapes."""
