"""A Spark-native analytics engine for large corpora of legal and regulatory documents."""
