"""A Spark-native engine for timestamped transcripts and clip catalogues."""
