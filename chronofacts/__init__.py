"""chronofacts: Spark-native analytics over time-stamped facts."""
