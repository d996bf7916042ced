"""framewright: a Spark-native engine for frame-indexed tables and text corpora."""
