"""shardloom: a Spark-native engine for retrieval experiments and corpus preparation."""
