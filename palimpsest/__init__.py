"""A Spark-native engine for versioned document graphs."""
