"""A Spark-native engine for symbol, search and graph analytics over code and text corpora."""
