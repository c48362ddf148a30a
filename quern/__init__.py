"""quern: a Spark-native analytics engine."""
