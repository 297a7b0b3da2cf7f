"""mosaiq: a Spark-native engine for multi-scale image regions and their tables."""
