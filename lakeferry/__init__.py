"""lakeferry: a Spark-native engine for loading, casting, merging and maintaining tables."""
