"""corvane: a Spark-native engine for semantic search, SQL over content, graphs and workflows."""
